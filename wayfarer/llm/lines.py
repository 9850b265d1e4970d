"""Line dedup: equal lines by hash, and lines within an edit threshold by a segment-partition join. DataFrame functions only.

A line is cut into threshold + 1 segments, of which a line within the threshold has one unchanged, shifted by no more
edits than can lie before or behind it. So each line is indexed under its length and each segment, and probes the index
of its own length and those up to threshold below with the substrings that can be such segments. Pairs that meet are
verified by a bit-parallel automaton of the band of diagonals that the threshold can reach. With threshold 1, index
entries with many lines make no pairs: there, lines meet under what is left when one character is taken out, where all
that meet are within one edit, and the earliest of them is an aggregated minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns, stored, table, text_or_empty, unused

THRESHOLD = 1  # edits that make two lines near
NEAR_CHARS = 20  # shorter lines are duplicates only of equal lines
PAIRED = 64  # with threshold 1, index entries with more lines go by deletions
BROADCAST_IDS = 200_000  # as many ids of 16 bytes are sent to all executors; more are joined
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line and its id (h1, h2) for each line with a word."""
    # the text's hash and its lines are made before the explode: what is named beside it is computed anew for each line
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split(text_or_empty(), "\n", -1).alias("lines"))
    rows = texts.select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line"))
    return rows.where(F.col("line").rlike(_HAS_WORD)).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def _first() -> Column:
    """Where a line first occurs."""
    return F.min(F.struct("doc_id", "text_key", "line_no"))


def _keys(line: Column, threshold: int) -> Column:
    """Index entries of a line, and its probes of entries of lines that are up to threshold characters shorter."""
    n = F.length(line)
    found = []
    for less in range(threshold + 1):
        begin = lambda k, l=n - less: (l * k / (threshold + 1)).cast("int")
        for k in range(threshold + 1):
            behind = threshold - k
            for shift in range(max(-k, less - behind), min(k, less + behind) + 1):
                part = F.substring(line, begin(k) + F.lit(shift + 1), begin(k + 1) - begin(k))
                found.append(F.struct(F.xxhash64(n - less, F.lit(k), part).alias("key"), F.lit(bool(less or shift)).alias("probe")))
    return F.array(*found)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def within_edits(r: Column, s: Column, threshold: int = THRESHOLD) -> Column:
    """Whether s, as long as r or up to threshold characters longer, is within threshold edits of it.

    For e from 0 to threshold, bits of the state are the 2 threshold + 1 diagonals that e edits or fewer reach.
    """
    chars = lambda x: F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))
    width = 2 * threshold + 1
    full = F.lit((1 << width) - 1).cast("long")
    begin = sum(((1 << e + 1) - 1) << threshold << e * width for e in range(threshold + 1))

    def run(both: Column) -> Column:
        a, b = both["a"], both["b"]
        # a null (past the end) equals nothing
        equal = lambda i, d: F.when(F.get(b, i + (d - threshold)) == F.get(a, i), F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long"))

        def step(state: Column, i: Column) -> Column:
            old = [F.shiftrightunsigned(state, e * width).bitwiseAND(full) for e in range(threshold + 1)]

            def level(m: Column, e: int, new: Column, after: Column) -> Column:
                """after with level e and those above it; new is the level below."""
                some = old[e].bitwiseAND(m).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)).bitwiseOR(F.shiftleft(new, 1).bitwiseAND(full))
                own = lambda x: after.bitwiseOR(F.shiftleft(x, e * width))
                return _let(some, lambda x: level(m, e + 1, x, own(x)) if e < threshold else own(x))

            matched = lambda m: _let(old[0].bitwiseAND(m), lambda x: level(m, 1, x, x))
            # no diagonal is left: nothing more is compared
            return F.when(state == 0, state).otherwise(_let(sum((equal(i, d) for d in range(1, width)), equal(i, 0)), matched))

        end = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(begin).cast("long"), step)
        return F.getbit(end, F.size(b) - F.size(a) + threshold * width + threshold) == 1

    return _let(F.struct(chars(r).alias("a"), chars(s).alias("b")), run)


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """h1, h2, line and first (where it first occurs) of the lines whose h1 is in ids."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return lines.join(ids, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"), _first().alias("first"))


def _met(crowd: DataFrame) -> DataFrame:
    """crowd(h1, h2, line, first) -> h1, h2, first, role and key: equal just for lines within one edit.

    What a line is without its character i is named by the hashes of what comes before and after the piece of some
    root of n characters that holds i, and of the rest of that piece, so that no line is copied for each character.
    A line of the same length is met as "changed", at the same i; one that is a character longer as "longer", there
    under the pieces of the shorter one, whose own key is "self"."""
    hashes = lambda x: (F.xxhash64(x), F.xxhash64(F.lit(7), x))
    text = lambda a, n: F.substring(F.col("line"), a + 1, n)
    rows = crowd.withColumn("n", F.length("line"))

    def pieces(length: Column) -> DataFrame:
        """A row per piece of the line as cut for lines of this length: its begin a, its size."""
        cut = rows.withColumn("l", length).withColumn("size", F.ceil(F.sqrt("l")).cast("int"))
        return cut.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("l") - 1, F.col("size"))))

    def named(parts: DataFrame, role: str, tail: Column, *more: Column) -> DataFrame:
        """The hashes of what comes before a and from tail on, and what tells the keys of this role apart."""
        return parts.select("h1", "h2", "first", F.lit(role).alias("role"), "l", "a", F.struct(*hashes(text(F.lit(0), F.col("a")))).alias("head"), F.struct(*hashes(text(tail, F.col("n")))).alias("tail"), *more)

    def without_one(parts: DataFrame, place: Column) -> DataFrame:
        """A row for each character of the piece, without it; place tells apart where it was."""
        each = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("piece"))))
        return each.withColumn("rest", F.expr("concat(left(piece, k - 1), substring(piece, k + 1))")).withColumn("place", place)

    size, a = F.col("size"), F.col("a")
    own = named(pieces(F.col("n")), "self", a + size, text(a, size).alias("rest"), F.lit(0).alias("place"))
    changed = without_one(named(pieces(F.col("n")), "changed", a + size, text(a, size).alias("piece")), F.col("k"))
    longer = without_one(named(pieces(F.col("n") - 1), "longer", a + size + 1, text(a, size + 1).alias("piece")), F.lit(0))
    key = F.struct("l", "a", "head", "tail", "place", F.struct(*hashes(F.col("rest"))))
    of = lambda x: x.select("h1", "h2", "first", "role", F.struct(F.xxhash64(key), F.xxhash64(F.lit(7), key)).alias("key"))
    return of(own).unionByName(of(changed)).unionByName(of(longer))


def near(lines: DataFrame, keys: DataFrame, paired: int = PAIRED, threshold: int = THRESHOLD) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line within threshold edits; lines are ordered by their first
    occurrence. keys(h1, keys) has the _keys() of lines."""
    keyed = keys.select("h1", F.inline("keys")).groupBy("key", "h1").agg(F.min("probe").alias("probe"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("probe"), 1)).alias("own")).where("n > 1 and own > 0")
    # counts and minima are stored before they are joined back: a join that reads an aggregation can't split a line or entry with very many rows
    crowded = stored(keyed.join(stored(sizes, "line-sizes"), "key").select("key", "h1", "probe", "n"), "line-keys")
    if crowded.isEmpty():  # no two lines share an entry
        return lines.select("h1", "h2").where("false")
    few = crowded.where(F.col("n") <= paired) if threshold == 1 else crowded
    a = few.where("not probe").select("key", F.col("h1").alias("a"))
    b = few.select("key", F.col("h1").alias("b"), "probe")
    met = a.join(b, "key").where("(probe and a <> b) or a < b")
    pairs = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    ids = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1")))
    if threshold == 1:
        many = stored(crowded.where(F.col("n") > paired).select("h1").distinct(), "line-many")
        ids = ids.unionByName(many)
    texts = stored(_texts(lines, stored(ids.distinct(), "line-ids")), "line-texts")

    left = texts.select(F.col("h1").alias("a"), F.struct("h1", "h2", "line", "first").alias("x"))
    right = texts.select(F.col("h1").alias("b"), F.struct("h1", "h2", "line", "first").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    shorter = F.length("x.line") <= F.length("y.line")
    linked = both.where(within_edits(F.when(shorter, F.col("x.line")).otherwise(F.col("y.line")), F.when(shorter, F.col("y.line")).otherwise(F.col("x.line")), threshold))
    later = linked.select(F.when(F.col("x.first") < F.col("y.first"), F.col("y")).otherwise(F.col("x")).alias("z")).select("z.h1", "z.h2")
    if threshold != 1 or many.isEmpty():
        return later.distinct()

    # many rows may come from few lines, so they are dealt anew
    met = _met(texts.join(many, "h1", "left_semi").repartition(lines.sparkSession.sparkContext.defaultParallelism * 4, "h1"))
    least = met.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("first"))).alias(r) for r in ("self", "changed", "longer")], F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    before = F.when(F.col("role") == "changed", F.col("changed")).when(F.col("role") == "self", F.col("longer")).otherwise(F.col("self"))
    crowd_later = met.join(stored(least, "line-least"), "key").where(before < F.col("first")).select("h1", "h2")
    return later.unionByName(crowd_later).distinct()


def dropped(docs: DataFrame, paired: int = PAIRED, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_key, exact, near: the line numbers to drop from each text that loses lines."""
    lines = _lines(docs)
    keys = F.when(F.length("line") >= NEAR_CHARS, _keys(F.col("line"), threshold)).alias("keys")
    occurrences = stored(lines.select("doc_id", "text_key", "line_no", "h1", "h2", keys), "line-hashes")
    keys, occurrences = occurrences.where("keys is not null").select("h1", "keys"), occurrences.drop("keys")
    several = occurrences.groupBy("h1", "h2").agg(_first().alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    here = F.struct("doc_id", "text_key", "line_no")
    exact = occurrences.join(stored(several, "line-several"), ["h1", "h2"]).where(~here.eqNullSafe(F.col("first"))).select("doc_id", "text_key", "line_no", F.lit(False).alias("near"))
    later = stored(near(lines, keys, paired, threshold), "line-near")
    close = occurrences.join(later, ["h1", "h2"], "left_semi").select("doc_id", "text_key", "line_no", F.lit(True).alias("near"))
    numbers = lambda is_near: F.collect_set(F.when(F.col("near") == is_near, F.col("line_no")))
    found = exact.unionByName(close).groupBy("doc_id", "text_key", "line_no").agg(F.max("near").alias("near"))
    return found.groupBy("doc_id", "text_key").agg(numbers(False).alias("exact"), numbers(True).alias("near"))


def without_repeats(docs: DataFrame, paired: int = PAIRED, threshold: int = THRESHOLD) -> DataFrame:
    """docs with n_lines, n_exact, n_near and kept: the text without lines that repeat an earlier one.

    Lines are what \\n separates; those without a word stay and are no one's repeat. Earlier is by doc_id (null first),
    then by line. A line goes if an equal line, or one of NEAR_CHARS characters or more within threshold edits, occurs
    earlier, be that line kept or not. A null text is empty. Repeated rows are treated alike and take nothing from
    each other. An empty table gives no rows. Columns of docs with these names are replaced; others stay, whatever
    their names. Thresholds over 1 compare the pairs of entries with many lines as well, within the join.
    """
    docs = docs.drop("n_lines", "n_exact", "n_near", "kept")
    row, own_id, own_key, exact, near_ = unused(docs, "row", "id", "key", "exact", "near")
    gone = stored(dropped(docs, paired, threshold), "line-dropped").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("exact").alias(exact), F.col("near").alias(near_))
    both = docs.withColumn(row, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(row) == F.col(own_key)), "left")
    parts = F.split(text_or_empty(), "\n", -1)
    left = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.concat(exact, near_))
    kept = F.array_join(_let(parts, lambda p: F.transform(left(p), lambda k: F.get(p, k))), "\n")
    return both.select(
        *own_columns(docs),
        F.size(F.filter(parts, lambda x: x.rlike(_HAS_WORD))).cast("long").alias("n_lines"),
        F.coalesce(F.size(exact), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce(F.size(near_), F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col(exact).isNull(), text_or_empty()).otherwise(kept).alias("kept"),
    )


def shortened(docs: DataFrame, paired: int = PAIRED, threshold: int = THRESHOLD) -> DataFrame:
    """docs, with all its columns, and the text that is left; texts of which no word is left, though they had some, go."""
    inner = docs.select("doc_id", "text", F.struct(*own_columns(docs)).alias("row"))
    found = without_repeats(inner, paired, threshold).where("n_lines = 0 or n_exact + n_near < n_lines")
    changed = F.col("n_exact") + F.col("n_near") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7_lines(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("kept", 256).alias("kept_sha256"))
