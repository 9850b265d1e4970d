"""Substring dedup by seed and extend: winnowed anchors find shared passages, window hashes extend them word by word.

A window of 50 words holds 26 anchors of 25 words; the one with the smallest hash is its seed, so equal windows have
equal seeds. Seeds that occur in different texts are found by one aggregation. Around those alone the extension goes
both ways, up to the window's width: every window that has the seed is hashed, and the smallest document that holds it
is an aggregated minimum, so a seed with any number of documents is extended against all of them at once. No two
documents are aligned word by word and no pairs are made: a match longer than a window is a chain of seeds, each
extended on its own, whose windows are merged to the maximal repeat. Exact copies of a text are found by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, text_bytes

WINDOW, ANCHOR = 50, 25
_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_KNOWN = 500_000  # word hashes remembered at a time


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


class _Powers:
    """base ** i modulo 2 ** 64, for as many i as were asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, self.base, np.uint64))])
        return self.known[:n]


class Rolling:
    """Hashes of all runs of k words, from sums of word hashes times powers of an odd base modulo 2 ** 64."""

    words, up, down = _Hashes(), _Powers(_BASE), _Powers(_INVERSE)

    def __init__(self, words: list[bytes], second: bool = False):
        self.n = len(words)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, self.n)
        self.sums = self._sums(h)
        self.sums2 = self._sums(_mixed(h * _MIX2 + _MIX1)) if second else None

    def _sums(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * self.up.first(self.n), out=out[1:])
        return out

    def runs(self, k: int, second: bool = False) -> np.ndarray:
        s = self.sums2 if second else self.sums
        return _mixed((s[k:] - s[:-k]) * self.down.first(self.n - k + 1))

    def seeds(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all anchors, for each window the place of its seed)."""
        anchors = self.runs(anchor)
        return anchors, sliding_window_view(anchors, window - anchor + 1).argmin(axis=1) + np.arange(self.n - window + 1)


def _each(docs: DataFrame, columns: str, find):
    """Rows that find gives for each text: find(row) returns arrays of one length, or none. doc_id and text_key go along."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            places, parts = [], []
            for k in range(batch.num_rows):
                found = find({c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in ("doc_id", "text_key")})
                if found is not None and len(found[0]):
                    places.append(np.full(len(found[0]), k, np.int64))
                    parts.append(found)
            if parts:
                at = pa.array(np.concatenate(places))
                data = [pa.array(np.concatenate([p[k] for p in parts]).view(np.int64) if t == pa.int64() else np.concatenate([p[k] for p in parts]).astype(np.int32), t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_key").take(at), *data], ["doc_id", "text_key", *names])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, {columns}")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the text, compressed for the shuffle."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([pack.compress(x.as_py()) for x in batch.column("text")], pa.binary())], ["doc_id", "text_key", "packed"])

    return narrow.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, packed binary")


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left and right's further columns, by doc_id (nulls are equal) and text_key."""
    right = right.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    return left.join(right, left["doc_id"].eqNullSafe(F.col("__id")) & (left["text_key"] == F.col("__key")), how).drop("__id", "__key")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For each text of docs(doc_id, text) with repeats: doc_id, text_key, copy, starts.

    starts: in no order, the windows whose words also start in a document with a smaller doc_id, where the text is the
    smallest of its exact copies; copy: the text is an exact copy of a smaller document's, so that all its windows are.
    """

    def seeds(row):
        if len(words := row["text"].split()) >= window:
            anchors, seed = Rolling(words).seeds(window, anchor)
            places = np.unique(seed)
            return anchors[places], places
        return None

    def extended(row):
        words = zstandard.decompress(row["packed"]).split()
        rolling = Rolling(words, second=True)
        _, seed = rolling.seeds(window, anchor)
        state = np.zeros(rolling.n, np.int8)
        state[row["own"]], state[row["later"]] = 1, 2
        found = np.nonzero(state[seed])[0]
        return rolling.runs(window)[found], (rolling.runs(window, True)[found] >> np.uint64(32)).astype(np.uint32).view(np.int32), found, state[seed][found]

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(7), "text").alias("key2"))
    first = keys.groupBy("text_key", "key2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    several = stored(first.where("n > 1").select("text_key", "key2", "first"), "substring-several")
    copies = keys.join(several, ["text_key", "key2"]).where("doc_id > first").select("doc_id", "text_key").distinct()
    anchors = stored(_each(texts, "anchor bigint, place int", seeds), "substring-anchors")
    # minima are stored before they are joined back: a join that reads an aggregation can't split an anchor or window with very many rows
    shared = anchors.groupBy("anchor").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.min("doc_id").alias("least")).where("a <> b")
    shared = stored(shared.select("anchor", "least"), "substring-shared")
    found = anchors.join(shared, "anchor").withColumn("later", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    at = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.when(~F.col("later"), F.col("place"))).alias("own"), F.collect_list(F.when(F.col("later"), F.col("place"))).alias("later"))
    copies = stored(copies, "substring-copies")
    seeded = _joined(at, copies, "left_anti")
    windows = stored(_each(_joined(_packed(docs), seeded, "inner"), "w1 bigint, w2 int, start int, state int", extended), "substring-windows")
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = stored(least.select("w1", "w2", "least"), "substring-least")
    removed = windows.where("state = 2").join(least, ["w1", "w2"]).where("doc_id > least")
    starts = removed.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    return starts.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("starts", F.array().cast("array<int>")).withColumn("copy", F.lit(True)))


def _covered(n: int, row: dict, window: int) -> np.ndarray:
    mask = np.zeros(n + 1, np.int64)
    if row["copy"]:
        mask[0] = n >= window
    elif row["starts"]:
        starts = np.asarray(row["starts"])
        np.add.at(mask, starts, 1)
        np.add.at(mask, starts + window, -1)
    return np.cumsum(mask)[:n] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text_key, n_words, n_removed, kept (the words left), spans.

    spans: the maximal repeats removed, as word offsets (begin, end, exclusive). A null text has no words. Rows without
    a doc_id lose nothing and cost others nothing. Repeated rows, and rows that share a doc_id, lose nothing to each
    other. An empty table gives no rows.
    """
    both = _joined(_packed(docs), stored(repeats(docs, window, anchor), "substring-repeats"), "left")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = zstandard.decompress(row["packed"]).split()
                gone = _covered(len(words), row, window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]) if edges else b" ".join(words)
                out.append((len(words), int(gone.sum()), kept.decode("utf-8", "replace"), [{"begin": a, "end": b} for a, b in edges]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], ["doc_id", "text_key", "n_words", "n_removed", "kept", "spans"])

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<begin:int,end:int>>")


def op4_substrings(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
