"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

Every source gets a target number of words. Its documents are dealt by hash over shards of a bounded number of
words; each shard's words, in hash order, are cut into blocks of (almost) block_words words. Blocks are the seats:
sources win them by highest quotients of their targets, groups of shards and then shards by highest quotients of their
words, so that each shard ends up with an integer quota. A shard takes all its blocks as often as the quota holds them
all, and the rest as a seeded permutation of its blocks orders them. No window is larger than one shard, the list of
sources, a source's groups or a group's shards, and no more than a row per shard meets the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, own_columns, stored, table, text_or_empty, unused

BLOCK_WORDS = 64
SHARD_BLOCKS = 8192
GROUP_SHARDS = 4096
SEED = 42


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources(source, source_size) with src, its number in code point order (null last), and target.

    Targets are proportional to the weights but stop at cap times the source's size, what is over going to the
    others by weight: the water level lambda at which sum(min(cap * size, lambda * weight)) is share of all sizes.
    """
    by_ratio = Window.orderBy("ratio", "src")
    whole = Window.partitionBy()
    numbered = (
        sources.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1))
        .withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.lit(cap) * F.sum("source_size").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # the level if all before this source are capped and it is not: the first that holds is the water level
    levels = numbered.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    found = levels.withColumn("lambda", F.min(F.when(F.col("fits"), F.struct("ratio", "src", "level"))).over(whole)["level"])
    target = F.coalesce(F.least(F.col("ratio"), F.col("lambda")), F.col("ratio")) * F.col("weight")
    return found.withColumn("target", F.least(target, F.lit(cap) * F.col("source_size"))).select("source", "src", "source_size", "target")


def seats_by_quotient(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """parties with `won`: how many of their group's `seats` each gets for its `votes` by the highest quotients votes / (2a + 1).

    With n parties, V votes and S seats, a quotient over V / (2S - n) always wins and one under V / (2S + n) never
    does: at most 2n quotients in between are ranked; ties go by `order`. Parties without votes get nothing.
    """
    own = Window.partitionBy(*group)
    v, s, n, all_votes = F.col(votes).cast("double"), F.col(seats), F.col("n_parties"), F.col("all_votes")
    certain = F.when((2 * s > n) & (v > 0), F.floor(v * (2 * s - n) / (2 * all_votes) + 0.5)).otherwise(F.lit(0)).cast("long")
    possible = F.when(v > 0, F.ceil(v * (2 * s + n) / (2 * all_votes) + 0.5)).otherwise(F.lit(0)).cast("long")
    bounds = (
        parties.withColumn("n_parties", F.count(F.lit(1)).over(own))
        .withColumn("all_votes", F.sum(F.col(votes).cast("double")).over(own))
        .withColumn("certain", certain)
        .withColumn("possible", F.greatest(possible, F.col("certain")))
        .withColumn("left", s - F.sum("certain").over(own))
    )
    asked = bounds.withColumn("a", F.explode(F.expr("if(possible > certain, sequence(certain, possible - 1), array(-1L))")))
    ranked = asked.withColumn("quotient", F.when(F.col("a") >= 0, v / (2 * F.col("a") + 1)).otherwise(F.lit(-1.0))).withColumn(
        "place", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("quotient").desc(), *order, "a"))
    )
    more = F.sum(F.when((F.col("place") <= F.col("left")) & (F.col("a") >= 0), 1).otherwise(0))
    key = list(dict.fromkeys(group + order))
    names = [c for c in parties.columns if c not in key]
    return ranked.groupBy(*key).agg(*[F.first(c).alias(c) for c in names], (F.first("certain") + more).alias("won"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a keyed permutation of the numbers from 0 to n - 1 puts x: four Feistel rounds over the least even number of
    bits that holds n, walked on until the number is below n again."""
    half = F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double")) / 2), F.lit(1)).cast("int")

    def run(p: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), p["half"]) - 1

        def turn(y: Column, k: int) -> Column:
            low = y.bitwiseAND(mask)
            high = F.call_function("shiftrightunsigned", y, p["half"])
            mixed = high.bitwiseXOR(F.xxhash64(*key, F.lit(k), low).bitwiseAND(mask))
            return F.call_function("shiftleft", low, p["half"]).bitwiseOR(mixed)

        def rounds(y: Column, k: int = 0) -> Column:
            return _let(turn(y, k), lambda z: rounds(z, k + 1) if k < 3 else z)

        def walk(y: Column, _: Column) -> Column:
            return F.when(y < p["n"], y).otherwise(rounds(y))

        # at most three in four numbers lie beyond n: some 200 steps are never all needed, and the rest cost nothing
        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), rounds(p["x"]), walk)

    return _let(F.struct(x.cast("long").alias("x"), n.cast("long").alias("n"), half.alias("half")), run)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, group_shards: int = GROUP_SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, text_key, row_key, begin, size, source_size, target, passes, extra, taken.

    passes: how often the mix takes the whole text; extra: the further spans it takes, as word offsets from, to;
    taken: the words of both. A null text has no words, a null source is a source of its own, the last. Documents
    without words take nothing. An empty table gives no rows; rows that are repeated are mixed like any others, and
    told apart by begin. The same rows and seed give the same result whatever the partitioning. cap times a text is
    the most it gives.
    """
    most = int(cap)
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_key"), row_key().alias("row_key")), "mix-sizes")
    sources = stored(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap).withColumn("seats", F.lit(0)), "mix-sources")
    seats = sources.drop("seats").withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    won = seats_by_quotient(seats.withColumn("all", F.lit(0)), ["all"], ["src"], "target", "seats").select("source", "src", "source_size", "target", F.col("won").alias("source_seats"))
    won = stored(won.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (block_words * shard_blocks)).cast("long"))), "mix-won")
    dealt = (
        sizes.join(won, sizes["source"].eqNullSafe(won["source"]))
        .select("doc_id", "text_key", "row_key", "size", "src", "source_size", "target", "source_seats", F.xxhash64(F.lit(seed), "doc_id").alias("h"), "n_shards")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("n_shards")))
    )
    shards = dealt.groupBy("src", "shard").agg(F.sum("size").alias("words"), F.first("source_seats").alias("source_seats")).withColumn("group", F.floor(F.col("shard") / group_shards))
    shards = stored(shards, "mix-shards")
    groups = seats_by_quotient(shards.groupBy("src", "group").agg(F.sum("words").alias("words"), F.first("source_seats").alias("source_seats")), ["src"], ["group"], "words", "source_seats")
    within = shards.select("src", "group", "shard", "words").join(groups.select("src", "group", F.col("won").alias("group_seats")), ["src", "group"])
    quotas = seats_by_quotient(within, ["src", "group"], ["shard"], "words", "group_seats").withColumn("n_blocks", F.greatest(F.lit(1).cast("long"), F.round(F.col("words") / block_words).cast("long")))
    quotas = quotas.withColumn("quota", F.least(F.col("won"), most * F.col("n_blocks"))).withColumn("passes", F.floor(F.col("quota") / F.col("n_blocks"))).withColumn("rest", F.col("quota") % F.col("n_blocks"))
    quotas = stored(quotas.select("src", "shard", "words", "n_blocks", "passes", "rest"), "mix-quotas")
    running = Window.partitionBy("src", "shard").orderBy("h", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("begin", F.coalesce(F.sum("size").over(running), F.lit(0).cast("long"))).join(quotas, ["src", "shard"]).withColumn("end", F.col("begin") + F.col("size"))
    block_of = lambda x: f"((({x}) + 1) * n_blocks - 1) div words"
    blocks = F.when((F.col("size") == 0) | (F.col("rest") == 0), F.array().cast("array<bigint>")).otherwise(F.expr(f"sequence({block_of('begin')}, {block_of('end - 1')})"))
    drawn = F.filter(blocks, lambda b: permuted(b, F.col("n_blocks"), F.lit(seed + 2), F.col("src"), F.col("shard")) < F.col("rest"))
    first, last = "greatest((b * words) div n_blocks, begin) - begin", "least(((b + 1) * words) div n_blocks, end) - begin"
    return (
        placed.withColumn("drawn", drawn)
        .withColumn("extra", F.expr(f"transform(drawn, b -> named_struct('from', {first}, 'to', {last}))"))
        .withColumn("taken", F.col("passes") * F.col("size") + F.expr("aggregate(extra, 0L, (a, s) -> a + s.to - s.from)"))
        .select("doc_id", "text_key", "row_key", "begin", "size", "source_size", "target", "passes", "extra", "taken")
    )


def row_key() -> Column:
    """What repeated rows share: 128 bits of id, source and text."""
    parts = (F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.col("text").isNull(), F.col("text"))
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, with the columns of docs: each text as often as its shard takes it whole, then the words of its
    further blocks, joined by one space, as one more row. Texts of which nothing is taken are left out. Of repeated
    rows, each takes one row of the plan."""
    key, copy, passes, extra, size, text = unused(docs, "key", "copy", "passes", "extra", "size", "text")
    numbered = mix_plan(docs, **options).withColumn("copy", F.row_number().over(Window.partitionBy("row_key").orderBy("begin")))
    plan = stored(numbered.select(F.col("row_key").alias(key), F.col("copy").alias(copy), F.col("passes").alias(passes), F.col("extra").alias(extra), F.col("size").alias(size)), "mix-plan")
    rows = docs.withColumn(key, row_key())
    # where no row is repeated, the texts need not be gathered by key to be numbered
    alone = plan.where(F.col(copy) > 1).isEmpty()
    rows = rows.withColumn(copy, F.lit(1) if alone else F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0))))
    both = rows.join(plan, [key, copy])
    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform(extra, lambda s: F.slice(words, s["from"].cast("int") + 1, (s["to"] - s["from"]).cast("int")))), " ")
    kept_whole = F.expr(f"size({extra}) > 0 and aggregate({extra}, 0L, (a, s) -> a + s.to - s.from) = {size}")
    partial = F.when(F.expr(f"size({extra}) = 0"), F.array()).otherwise(F.array(F.when(kept_whole, F.col("text")).otherwise(part)))
    texts = F.concat(F.array_repeat(F.col("text"), F.col(passes).cast("int")), partial.cast("array<string>"))
    out = both.withColumn(text, F.explode(texts)).withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own_columns(docs))


def op9_mixing(spark, sf_dir):
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
