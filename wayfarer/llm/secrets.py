"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every version of a path is addressed by the hash of its content. The ledger has a row for each pair of blob and rule
version that was ever scanned, with the spans found. Only pairs that it lacks are scanned, each blob's text once;
findings are then joined back to all paths and versions with that content.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of pattern, kept if its group has least characters; only texts with `needs` are searched."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    needs: str = ""


BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # runs of fewer characters are never kept
)
RULES = (
    *BASE,
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
)
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule in code points: the text between matches and the matches follow each other in turn."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("match"), group.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["match"]), F.lit(0))
        more = F.when(F.length(part["value"]) >= rule.least, F.array_append(state["out"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(state["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    # after the last gap there is no match: its null value is not kept
    spans = F.aggregate(parts, start, step, lambda state: state["out"])
    worth = text.rlike(rule.pattern) if not rule.needs else text.contains(rule.needs)
    return F.when(worth, spans).otherwise(F.array().cast(_SPANS))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) for versions(path, text): one row for each version, its content scanned by all rules.

    findings: path, blob and spans, a map from kind to its spans in order. ledger: blob, kind, rule_version, spans;
    give it to the next call, which then scans only new blobs, and old ones under new rule versions. A null text is
    empty. Repeated versions have a row each; an empty table gives none. Rules of the same kind supersede by version.
    """
    addressed = versions.select("path", text_or_empty().alias("text")).withColumn("blob", F.sha2("text", 256))
    asked = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is None:
        wanted = addressed.groupBy("blob").agg(F.first("text").alias("text")).withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pairs = addressed.select("blob").distinct().select("blob", F.inline(asked))
        unseen = pairs.join(ledger, ["blob", "kind", "rule_version"], "left_anti").groupBy("blob").agg(F.collect_set("kind").alias("kinds"))
        wanted = addressed.join(unseen, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("kinds").alias("kinds"))
    each = [F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), _spans(F.col("text"), r).alias("spans"))) for r in rules]
    entries = stored(wanted.select("blob", F.filter(F.array(*each), lambda x: x.isNotNull()).alias("entries")), "secret-ledger").select("blob", F.inline("entries"))
    known = entries if ledger is None else ledger.unionByName(entries)
    current = known.join(F.broadcast(versions.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "kind string, rule_version int")), ["kind", "rule_version"])
    by_blob = current.where("size(spans) > 0").groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("kind", "spans"))).alias("spans"))
    findings = addressed.select("path", "blob").join(by_blob, "blob", "left")
    return findings.withColumn("spans", F.coalesce("spans", F.create_map().cast(f"map<string,{_SPANS}>"))), known


def span_text(kinds: tuple[str, ...], spans: str = "spans") -> Column:
    """kind:start:end of all spans of these kinds, by start, then kind as listed, comma-joined."""
    of = lambda k, kind: F.transform(F.coalesce(F.try_element_at(spans, F.lit(kind)), F.array().cast(_SPANS)), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    ordered = F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(kinds)]))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark, sf_dir):
    findings, _ = scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    number = lambda kind: F.coalesce(F.size(F.try_element_at("spans", F.lit(kind))), F.lit(0)).cast("long")
    return findings.select(
        F.col("path").alias("doc_id"),
        *[number(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(span_text(tuple(r.kind for r in BASE)), 256).alias("base_sha256"),
        span_text(tuple(r.kind for r in RULES)).alias("spans"),
    )


def op2_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS o, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{quoted(r.pattern)}', 0) AS m, regexp_extract_all(t, '{quoted(r.pattern)}', {r.group}) AS g, regexp_split_to_array(t, '{quoted(r.pattern)}') AS s FROM d"
        for k, r in enumerate(RULES)
    )
    base = f"o < {len(BASE)}"
    counted = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in BASE)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({kinds}),
        e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
        p AS (SELECT doc_id, o, kind, least, length(g[i]) AS n, length(m[i]) AS width,
            CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b FROM e),
        f AS (SELECT doc_id, o, kind, b, kind || ':' || b || ':' || (b + width) AS span FROM p WHERE n >= least),
        a AS (SELECT doc_id, {counted}, string_agg(span, ',' ORDER BY b, o) FILTER (WHERE {base}) AS base, string_agg(span, ',' ORDER BY b, o) AS spans FROM f GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a ON d.doc_id = a.doc_id
    """
