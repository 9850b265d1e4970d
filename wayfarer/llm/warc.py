"""WARC archives with a two-level capture index.

Pages are range-partitioned and sorted by their key, the URL with its host reversed. Each task writes an archive of
gzip members and, beside it, the index of its captures: sorted lines in compressed blocks. The sparse directory has
a row per block: its first and last key, file, offset and length. A lookup finds the range of the directory by binary
search, the blocks along the sorted range, and the line by binary search in the block; then it reads byte ranges.
A task that is run again writes new files; only files that the stored directory names are ever read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from itertools import accumulate, groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import new_path, stored, table, text_bytes

LEAST_REVISIT = 100  # payloads of fewer bytes are always stored
BLOCK_LINES = 256
SHARD_ROWS = 20_000
BROADCAST_ROWS = 100_000
RANGES = 4096  # the most that a directory is parted into for lookups
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str = "url") -> Column:
    """Sort key of a URL: host labels reversed, port, path and query; without scheme, user and fragment. A null URL has '-'."""
    text = F.coalesce(F.col(url), F.lit("-"))
    site = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)"
    host, port, rest = (F.regexp_extract(text, site, k) for k in (1, 2, 3))
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), port, F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.regexp_replace(F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), key).otherwise(text), r"[\x00-\x20]", "%20")


def captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, surt, refers_to: null unless an equal payload is stored for a smaller page_id."""
    rows = pages.select("page_id", "url", text_bytes("html").alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("surt", surt())
    same = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    same = stored(same, "warc-same")
    if same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    return rows.join(same, "digest", "left").withColumn("refers_to", F.when((F.col("page_id") > F.col("first")) | F.col("page_id").isNull(), F.col("first"))).drop("first")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder named by a URI or a local path."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record() in data, checked against its own digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload}


_DIRECTORY = "shard int, first_key string, last_key string, archive string, index string, offset bigint, length bigint, n bigint"


def write_archives(pages: DataFrame, folder: str | None = None, shard_rows: int = SHARD_ROWS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes an archive and its index per shard of pages(page_id, url, html) to folder; returns the stored block directory.

    A null html is an empty payload, a null url has the key '-' and no target. Repeated rows are captured each time;
    of equal payloads all rows with the smallest page_id are responses. An empty table gives an empty directory.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    shards = max(1, -(-pages.count() // shard_rows))
    ranged = captures(pages).repartitionByRange(shards, "surt", "page_id").sortWithinPartitions("surt", "page_id", "digest")

    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        lines, rows, at, index_at, archive, index = [], [], 0, 0, None, None

        def close_block():
            nonlocal index_at, lines
            data = zlib.compress("\n".join(x[1] for x in lines).encode(), 6)
            index.write(data)
            rows.append((shard, lines[0][0], lines[-1][0], f"{name}.warc.gz", f"{name}.idx", index_at, len(data), len(lines)))
            index_at, lines = index_at + len(data), []

        for batch in batches:
            if batch.num_rows and archive is None:
                archive, index = store.open_output_stream(f"{root}/{name}.warc.gz", compression=None), store.open_output_stream(f"{root}/{name}.idx", compression=None)
            for x in batch.to_pylist():
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = pack.compress(record(x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"])) + pack.flush()
                archive.write(member)
                lines.append((x["surt"], f"{x['surt']} {at} {len(member)}"))
                at += len(member)
                if len(lines) >= block_lines:
                    close_block()
        if lines:
            close_block()
        if archive is not None:
            archive.close()
            index.close()
        schema = pa.schema([(k, {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64()}[t]) for k, t in (c.split() for c in _DIRECTORY.split(", "))])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    written = ranged.select("page_id", "url", "payload", "digest", "surt", "refers_to").mapInArrow(run, _DIRECTORY)
    return stored(written.withColumn("folder", F.lit(folder)), "warc-directory")


def _lines(store, root: str, block: dict) -> list[list[str]]:
    with store.open_input_file(f"{root}/{block['index']}") as f:
        f.seek(block["offset"])
        return [x.split(" ") for x in zlib.decompress(f.read(block["length"])).decode().split("\n")]


def _members(store, root: str, archive: str, ranges: list[tuple[int, int]]):
    """The records at (offset, length) in an archive, in order; ranges that touch are read at once."""
    with store.open_input_file(f"{root}/{archive}") as f:
        before = accumulate((n for _, n in ranges), initial=0)
        for _, run in groupby(zip(ranges, before), key=lambda x: x[0][0] - x[1]):
            own = [r for r, _ in run]
            f.seek(own[0][0])
            data, at = f.read(sum(n for _, n in own)), 0
            for _, n in own:
                yield parse(zlib.decompress(data[at : at + n], 31))
                at += n


_RECORD = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_RECORD_DDL = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(directory: DataFrame, payloads: bool = False) -> DataFrame:
    """All records, by way of the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for."""
    names = [k for k in _RECORD if payloads or k != "payload"]

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                store, root = _store(block["folder"])
                found = list(_members(store, root, block["archive"], [(int(a), int(n)) for _, a, n in _lines(store, root, block)]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], _RECORD[k]) for k in names], names)

    parts = max(directory.sparkSession.sparkContext.defaultParallelism, directory.count() // 64)
    return directory.repartition(parts, "index", "offset").mapInArrow(run, _RECORD_DDL + (", payload binary" if payloads else ""))


def _ranges(directory: DataFrame) -> list[bytes]:
    """Keys that part the directory into at most RANGES ranges of like numbers of shards: a list of bounded size."""
    shards = directory.groupBy("shard").agg(F.min("first_key").alias("low"))
    step = max(1, -(-shards.count() // RANGES))
    return sorted({r["low"].encode() for r in shards.where(F.col("shard") % step == 0).select("low").collect()})


def _found(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """wanted and the row of each block that can hold it, for each distinct key of urls.

    Keys and blocks are dealt to the directory's ranges by binary search, a block to all that it touches, and sorted
    there. A task goes along both and holds one block: the one before a key is the only one that begins before it and
    can end behind it; those that begin with it follow."""
    bounds = _ranges(directory)
    blocks = [f for f in directory.schema.names if f not in ("first_key", "last_key")]

    def dealt(batches):
        for batch in batches:
            low = [bisect_right(bounds, x.encode()) for x in batch.column("key").to_pylist()]
            high = [bisect_right(bounds, x.encode()) for x in batch.column("last_key").to_pylist()]
            at = [k for k, (a, b) in enumerate(zip(low, high, strict=True)) for _ in range(a, b + 1)]
            part = [p for a, b in zip(low, high, strict=True) for p in range(a, b + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[c.take(pa.array(at, pa.int64())) for c in batch.columns]], ["part", *batch.schema.names])

    keys = urls.select(surt().alias("key")).distinct().select("key", F.col("key").alias("last_key"), F.lit(0).alias("kind"), *[F.lit(None).cast(directory.schema[c].dataType).alias(c) for c in blocks])
    both = keys.unionByName(directory.withColumnRenamed("first_key", "key").withColumn("kind", F.lit(1)))
    sorted_ = both.mapInArrow(dealt, StructType([StructField("part", IntegerType()), *both.schema.fields])).repartition(max(len(bounds) + 1, urls.sparkSession.sparkContext.defaultParallelism), "part").sortWithinPartitions("part", "key", "kind", "index", "offset")

    def met(batches):
        part = wanted = block = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, wanted, block = row["part"], None, None
                if row["kind"] == 0:
                    wanted = row["key"]
                    if block and block["last_key"].encode() >= wanted.encode():
                        out.append({**block, "wanted": wanted})
                else:
                    block = row
                    if wanted == row["key"]:
                        out.append({**block, "wanted": wanted})
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("wanted", *blocks)} for r in out], schema=pa.schema([("wanted", pa.string()), *[(c, batch.schema.field(c).type) for c in blocks]]))

    return sorted_.mapInArrow(met, StructType([StructField("wanted", StringType()), *[directory.schema[c] for c in blocks]]))


def lookup(directory: DataFrame, urls: DataFrame, payloads: bool = True) -> DataFrame:
    """urls(url) -> wanted, the key, and the records of all captures under it; unknown URLs have no row.

    Keys meet the blocks that can hold them along the sorted directory; the key's lines are found in the block by
    binary search, and only their byte ranges are read. Keys that share a block are read one after the other."""
    names = [k for k in _RECORD if payloads or k != "payload"]
    found = _found(directory, urls)
    pairs = found.repartition(max(urls.sparkSession.sparkContext.defaultParallelism, directory.count() // 64), "index", "offset").sortWithinPartitions("index", "offset", "wanted")

    def run(batches):
        last = lines = keys = None
        for batch in batches:
            for at, own in groupby(batch.to_pylist(), key=lambda b: (b["folder"], b["index"], b["offset"])):
                own = list(own)
                store, root = _store(own[0]["folder"])
                if at != last:
                    last, lines = at, _lines(store, root, own[0])
                    keys = [x[0].encode() for x in lines]
                wanted, ranges = [], []
                for block in own:
                    key = block["wanted"].encode()
                    for _, begin, length in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                        wanted.append(block["wanted"])
                        ranges.append((int(begin), int(length)))
                found = list(_members(store, root, own[0]["archive"], ranges))
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.string()), *[pa.array([x[c] for x in found], _RECORD[c]) for c in names]], ["wanted", *names])

    return pairs.mapInArrow(run, f"wanted string, {_RECORD_DDL}" + (", payload binary" if payloads else ""))


def op6_warc(spark, sf_dir):
    """Every page written, and found again by its URL's key."""
    pages = table(spark, sf_dir, "pages")
    return lookup(write_archives(pages), pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
