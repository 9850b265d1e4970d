"""Quality rules: counts of every whole text, and robust multivariate outliers within language and source.

The counts become a vector of transformed statistics. For each (language, source), each language, and all documents,
the minimum covariance determinant is sought: the location and scatter of the 75 % of vectors that lie closest
together. Several starts (medians and quartiles, all vectors, two shares drawn by hash) go through concentration steps
until no determinant shrinks any more, and the estimate with the smallest determinant is taken; every step is one
aggregation over all vectors, so no group is ever gathered. A document is judged by the smallest pool that has min_pool
vectors, and rejected beyond a Mahalanobis distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, freeing, own_columns, slices, small_batches, stored, table, text_bytes, unused

#: (transformed statistic, least standard deviation: what differs by less is never an outlier for it)
STATISTICS = (
    ("ln(n_words)", 0.8),
    ("ln(word_chars / n_words)", 0.08),
    ("ln(1 + 50 * n_symbols / word_chars)", 0.15),
    ("ln(1 + n_dup_lines)", 0.4),
    ("sqrt(n_repeat_words / n_words)", 0.08),
)
P = len(STATISTICS)
HALF_CHI2 = 4.3515  # median of chi-squared with 5 degrees of freedom
COVER, STEPS, BINS, FIXED_POINT = 0.75, 12, 16, 1024  # STEPS: the most; they end when no determinant shrinks by TOLERANCE
TOLERANCE = 0.01  # of a determinant's logarithm
SLICE_BYTES = 4_000_000  # of text that a worker counts at a time
FIT_TASKS = 8  # estimates are a row per pool and start
BROADCAST_FITS = 100_000  # as many estimates of some 350 bytes are sent to all executors; more are joined
SHARES = (101, 102)  # seeds of the shares of vectors that starts are drawn from, one in SHARE_OF
SHARE_OF = 8
FALSE_REJECTION = 1e-14  # of vectors whose statistics are normal: under one in the largest corpora
MIN_POOL = 6 * P  # twice the fifteen entries of a scatter matrix
SYMBOLS = b"#*$%&|<>"


def cutoff_for(share: float) -> float:
    """The squared distance that a share of chi-squared values with 5 degrees of freedom exceeds."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        x = (low + high) / 2
        beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        low, high = (x, high) if beyond > share else (low, x)
    return low


CUTOFF = cutoff_for(FALSE_REJECTION)  # 74.9


def _repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    pairs = ids[:-2] * v + ids[1:-1]
    if v > 2_000_000:  # else three numbers fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs * v + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(b"".join(words).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, lang, source, text_key and the five counts; a null text has no words."""
    narrow = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    fields = [f for f in narrow.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + "".join(f", {c} bigint" for c in COUNTS)

    def run(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            found = [_counts(x.as_py()) for x in batch.column("text")]
            columns = [batch.column(f.name) for f in fields] + [pa.array([x[k] for x in found], pa.int64()) for k in range(P)]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), *COUNTS])

    return narrow.mapInArrow(freeing(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _pools() -> Column:
    """The pools of a row from small to large; null languages and sources count as values."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("lang", "source"))
    return F.array(F.concat_ws("\x01", F.lit("0"), lang, source), F.concat_ws("\x01", F.lit("1"), lang), F.lit("2"))


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _estimate(n: pd.Series, sums: pd.Series) -> pd.DataFrame:
    """Mean, inverse scatter and log determinant from the count and the sums of x and of x x', both in fixed point."""
    floor = np.diag([s * s for _, s in STATISTICS])
    rows = []
    for count, s in zip(n, sums, strict=True):
        s = np.asarray(s, float)
        mean = s[:P] / FIXED_POINT / max(count, 1)
        second = np.zeros((P, P))
        for k, (i, j) in enumerate(_PAIRS):
            second[i, j] = second[j, i] = s[P + k] / FIXED_POINT**2 / max(count, 1)
        scatter = second - np.outer(mean, mean) + floor
        rows.append((mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
    return pd.DataFrame(rows, columns=["mean", "inverse", "logdet"])


def _sent(fit: DataFrame) -> DataFrame:
    """A stored table with a row per pool, for a join that leaves the other side where it is if the table is small: a pool
    may hold all rows."""
    return F.broadcast(fit) if fit.count() <= BROADCAST_FITS else fit


def _distance() -> Column:
    """Squared Mahalanobis distance of v (fixed point) under mean and inverse."""
    d = [F.col("v")[i] / FIXED_POINT - F.col("mean")[i] for i in range(P)]
    return sum((2.0 if j > i else 1.0) * d[i] * d[j] * F.col("inverse")[i * P + j] for i, j in _PAIRS)


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    v = F.col("v")
    sums = [F.sum(v[i]).alias(f"s{i}") for i in range(P)] + [F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i, j in _PAIRS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


_SUMS = [f"s{i}" for i in range(P)] + [f"s{i}_{j}" for i, j in _PAIRS]


def _fitted(moments: DataFrame, before: Column) -> DataFrame:
    """pool, start, mean, inverse, logdet of the moments, and before, the determinant that the start had."""
    estimate = F.pandas_udf(_estimate, "mean array<double>, inverse array<double>, logdet double")
    fit = moments.coalesce(FIT_TASKS).withColumn("fit", estimate("n", F.array(*[F.col(c).cast("double") for c in _SUMS])))
    return fit.select("pool", "start", F.col("fit.mean").alias("mean"), F.col("fit.inverse").alias("inverse"), F.col("fit.logdet").alias("logdet"), before.alias("before"))


def _centre(vectors: DataFrame) -> DataFrame:
    """The first start: per pool, medians of each statistic and the spread of the middle half, from exact histograms."""
    cells = vectors.select("pool", F.posexplode(F.transform("v", lambda x: F.floor(x / 32))).alias("i", "bin")).groupBy("pool", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("pool", "i")
    up = cells.withColumn("share", F.sum("n").over(own.orderBy("bin")) / F.sum("n").over(own))
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("bin"))) * 32.0 / FIXED_POINT
    spread = F.element_at(F.array(*[F.lit(s) for _, s in STATISTICS]), F.col("i") + 1)
    each = up.groupBy("pool", "i").agg(at(0.5).alias("middle"), (at(0.75) - at(0.25)).alias("quartiles"))
    each = each.withColumn("weight", 1 / (F.pow(F.col("quartiles") / 1.349, 2) + spread * spread))
    gathered = each.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("i", "middle", "weight"))).alias("d"))
    inverse = F.array(*[F.col("d")[i]["weight"] if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    return gathered.select("pool", F.lit(0).alias("start"), F.transform("d", lambda x: x["middle"]).alias("mean"), inverse.alias("inverse"), F.lit(math.inf).alias("logdet"), F.lit(math.inf).alias("before")).coalesce(FIT_TASKS)


def _drawn(vectors: DataFrame) -> DataFrame:
    """The other starts: moments of all vectors, and of shares drawn by hash."""
    shares = [F.when(F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(SHARE_OF)) == 0, k) for k, seed in enumerate(SHARES, 2)]
    dealt = vectors.withColumn("start", F.explode(F.array_compact(F.array(F.lit(1), *shares))))
    return _fitted(_moments(dealt, "pool", "start"), F.lit(math.inf)).withColumn("logdet", F.lit(math.inf))


def _bin() -> Column:
    return F.floor(F.log(F.greatest(_distance(), F.lit(1e-9))) * BINS).alias("bin")


def _concentrated(vectors: DataFrame, fit: DataFrame) -> DataFrame:
    """One step from each start: moments of the COVER share of vectors that lie closest (whole distance bins), refitted."""
    binned = vectors.join(_sent(fit), "pool").select("pool", "start", "logdet", "v", _bin())
    own = Window.partitionBy("pool", "start").orderBy("bin")
    moments = _moments(binned, "pool", "start", "logdet", "bin").withColumn("below", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    moments = moments.withColumn("all", F.sum("n").over(Window.partitionBy("pool", "start"))).where(F.col("below") < COVER * F.col("all"))
    return _fitted(moments.groupBy("pool", "start").agg(F.first("logdet").alias("before"), *[F.sum(c).alias(c) for c in ("n", *_SUMS)]), F.col("before"))


def estimates(vectors: DataFrame) -> DataFrame:
    """vectors(pool, v) -> pool, mean, inverse: of the starts' estimates that with the smallest determinant."""
    fit = stored(_centre(vectors).unionByName(_drawn(vectors)), "quality-fit")
    for _ in range(STEPS):
        last, fit = fit, stored(_concentrated(vectors, fit), "quality-fit")
        forget(last)
        if fit.where(F.col("before") - F.col("logdet") > TOLERANCE).isEmpty():
            break
    best = fit.groupBy("pool").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("x"))
    return stored(best.select("pool", "x.mean", "x.inverse"), "quality-best")


def judged(docs: DataFrame, cutoff: float = CUTOFF, min_pool: int = MIN_POOL) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, source): doc_id, text_key, the five counts, base_failed, distance, kept.

    Documents that fail the base rules have no vector and are rejected; of the rest, those are whose squared distance,
    scaled so that half the pool lies within the chi-squared median, exceeds cutoff, by default the chi-squared value
    that a share of FALSE_REJECTION exceeds. With fewer than min_pool vectors in all, too few for a scatter matrix,
    nothing but the base rules rejects. Null languages and sources are values of their own; repeated rows count each
    time and are judged alike; an empty table gives no rows.
    """
    vector = F.array(*[F.round(F.expr(e) * FIXED_POINT).cast("long") for e, _ in STATISTICS])
    with small_batches(docs.sparkSession):
        rows = stored(counts(docs), "quality-counts")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("v", F.when(~F.col("base_failed"), vector)).withColumn("pools", _pools())
    vectors = rows.where("not base_failed").select("v", F.explode("pools").alias("pool"))
    fit = estimates(vectors)
    own = Window.partitionBy("pool")
    cells = vectors.join(_sent(fit), "pool").groupBy("pool", _bin()).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("all", F.sum("n").over(own)).withColumn("up", F.sum("n").over(own.orderBy("bin")))
    scale = cells.groupBy("pool").agg(F.max("all").alias("n"), (F.exp((F.min(F.when(F.col("up") >= 0.5 * F.col("all"), F.col("bin"))) + 1) / BINS) / HALF_CHI2).alias("scale"))
    # statistics that hardly vary leave small distances, which are not stretched
    pools = stored(fit.join(scale.where(F.col("n") >= min_pool), "pool").withColumn("scale", F.greatest("scale", F.lit(1.0))), "quality-pools")
    named = rows.select("*", *[F.col("pools")[k].alias(f"pool{k}") for k in range(3)])
    pools = _sent(pools)
    for k in range(3):
        named = named.join(pools.select(F.col("pool").alias(f"pool{k}"), F.struct("mean", "inverse", "scale").alias(f"fit{k}")), f"pool{k}", "left")
    best = F.coalesce("fit0", "fit1", "fit2")
    scored = named.withColumns({"mean": best["mean"], "inverse": best["inverse"], "scale": best["scale"]}).withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return scored.select("doc_id", "text_key", *COUNTS, "base_failed", "distance", kept.alias("kept"))


def passed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all its columns."""
    own_id, own_key, row = unused(docs, "id", "key", "row")
    kept = judged(docs, **options).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).dropDuplicates()
    return docs.withColumn(row, F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_key)), "left_semi").select(*own_columns(docs))


def op5_quality(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
