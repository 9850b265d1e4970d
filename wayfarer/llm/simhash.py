"""SimHash near duplicates: fingerprints of word shingles, linked by pigeonring filtering, and their components.

64 bits form a ring of 16 segments. If two fingerprints differ in 2 bits at most, some chain of consecutive segments
starts at which the differences, summed over its first l segments, never exceed l * 2 / 16. So its first seven
segments are equal: their 28 bits are the join key. Sums over longer chains prune candidates before the full distance.
Keys with many fingerprints are not paired. Two fingerprints are within 2 bits just if a third is within 1 bit of
both, so the fingerprints of those keys meet at their 64 neighbours, where at most 65 can be, and form stars there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import stored, table, text_bytes
from .components import components
from .near_copies import heads

SEGMENTS, BITS = 16, 2
WIDTH = 64 // SEGMENTS
EXACT = -(-SEGMENTS // BITS) - 1  # so many segments of a chain must be equal
SEED = 42
PAIRED = 64  # keys with more fingerprints go by neighbours


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash as a signed 64-bit number; a text without words has 0."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65536):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_key, fp; a null text has no words."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))

    def run(batches):
        for batch in batches:
            fp = pa.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), fp], ["doc_id", "text_key", "fp"])

    return narrow.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, fp bigint")


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """prints(fp), distinct -> u, v: edges that connect just what chains of links at BITS or fewer differing bits connect."""
    turned = F.array(*[F.expr(f"shiftleft(fp, {WIDTH * r}) | shiftrightunsigned(fp, {64 - WIDTH * r})" if r else "fp") for r in range(SEGMENTS)])
    keyed = prints.select("fp", F.posexplode(turned).alias("r", "turned")).withColumn("key", F.col("r").cast("long") * (1 << EXACT * WIDTH) + F.shiftrightunsigned("turned", 64 - EXACT * WIDTH))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stored(keyed.join(stored(sizes, "simhash-sizes"), "key").select("key", "fp", "turned", "n"), "simhash-keys")
    few = crowded.where(F.col("n") <= paired)
    a, b = few.select("key", F.col("fp").alias("u"), F.col("turned").alias("tu")), few.select("key", F.col("fp").alias("v"), F.col("turned").alias("tv"))
    pairs = a.join(b, "key").where("u < v").withColumn("x", F.col("tu").bitwiseXOR(F.col("tv")))
    for l in range(EXACT + 1, SEGMENTS + 1):  # noqa: E741
        pairs = pairs.where(F.bit_count(F.shiftrightunsigned("x", 64 - WIDTH * l)) <= l * BITS // SEGMENTS)
    many = crowded.where(F.col("n") > paired).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.expr(f"shiftleft(1L, {k})")) for k in range(64)])
    meeting = many.select("fp", F.explode(near).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    stars = meeting.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return pairs.select("u", "v").unionByName(stars).distinct()


def _rooted(docs: DataFrame, shingle: int, paired: int) -> DataFrame:
    """The rows of grouped() with root, a fingerprint of the component."""
    rows = stored(fingerprints(docs, shingle), "simhash-prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(prints.select("fp"), paired))
    at = prints.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = stored(at.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = at.join(least, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def grouped(docs: DataFrame, shingle: int = 3, paired: int = PAIRED) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text_key, fp, component_id, the smallest doc_id that links reach.

    Texts without words have fingerprint 0 and are linked like any other; null texts have no words. Rows without a
    doc_id take part, but give their component no id: it is null where all of its rows lack one. Repeated rows have a
    row each, with the same component. An empty table gives no rows.
    """
    return _rooted(docs, shingle, paired).drop("root")


def one_of_each(docs: DataFrame, shingle: int = 3, paired: int = PAIRED, similarity: float | None = None) -> DataFrame:
    """Of each component, the document with the smallest doc_id, with the columns of docs. Rows without a doc_id stay.

    With a similarity, texts are linked where the Jaccard similarity of their sets of shingles is that or more. At 0.8
    fingerprints differ in some 10 of 64 bits, for which no segment of a ring need be equal that would leave few
    candidates; so fingerprints are longer there (rings), MinHash bands add the pairs that no chain of the ring finds,
    and all candidates are verified on the whole sets."""
    return heads(docs, _rooted(docs, shingle, paired) if similarity is None else near_copies.rooted(docs, shingle, similarity))


def op10_simhash(spark, sf_dir):
    found = grouped(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
