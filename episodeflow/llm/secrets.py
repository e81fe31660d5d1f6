"""Secret scans by a trigram inverted index, in DataFrame operations alone.

Method
------
Each rule's pattern gives a Boolean query over trigrams that its matches must
contain (``trigrams.query``, on the driver, from the pattern alone). The inverted
index has a posting list for each of those trigrams and each segment of
``SEGMENT`` consecutive rows: the rows of the segment whose lower-cased text
contains the trigram. Trigrams that no rule asks for are not indexed. The
queries are answered within each segment by intersecting and uniting posting
lists, which are bounded by the segment's size. The texts of candidate rows are
then verified with the pattern itself; a rule without mandatory trigrams scans
every text.

A pattern's matches are leftmost and don't overlap. Their offsets are sums of
the lengths of the matches and of the pieces between them, in code points.

The index sends only row numbers through shuffles. Texts stay where they are
while the candidates are few enough to be broadcast (``common.small_side``);
beyond that they move once, dealt out by row number.

Defined cases: a null text is empty and has no secrets; repeated rows and null
ids are scanned each; an empty table gives an empty result; other columns pass
through, and one with the name of an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, read_table, small_side, stage_input, stage_output, with_row_id
from .trigrams import query

SEGMENT_BITS = 12


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose ``group`` has under ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # AKIA[A-Z0-9]+ of 18 and [0-9a-f]+ of 16 characters or more: a match runs on to the
    # last character of its class, so one that is too short hides no other match, and
    # the length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
EXTRA = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("hub", r"gh[opsu]_[A-Za-z0-9]{36}"),
)


def _posting_index(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(segment, postings): for each segment a map from trigram to row numbers."""
    low = rows.select("_row", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    entries = low.select("_row", present.alias("trigrams")).select("_row", F.explode("trigrams").alias("trigram"))
    lists = entries.groupBy(F.shiftright("_row", SEGMENT_BITS).alias("segment"), "trigram").agg(F.collect_list("_row").alias("rows"))
    return lists.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("postings"))


def _answer(clauses) -> Column:
    """The rows of a segment that satisfy a trigram query."""
    none = F.array().cast("array<bigint>")
    posting = lambda t: F.coalesce(F.element_at("postings", F.lit(t)), none)
    every = lambda xs: reduce(F.array_intersect, xs)
    return every([reduce(F.array_union, [every([posting(t) for t in sorted(a)]) for a in sorted(clause, key=sorted)]) for clause in clauses])


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(_row, _rules): which rules' trigram queries a row satisfies; None where no rule has one."""
    queries = {r.kind: query(r.pattern) for r in rules}
    queries = {k: q for k, q in queries.items() if q}
    if not queries:
        return None
    index = _posting_index(rows, sorted({t for q in queries.values() for clause in q for a in clause for t in a}))
    named = lambda q, k: F.transform(_answer(q), lambda r: F.struct(r.alias("_row"), F.lit(k).alias("kind")))
    found = F.concat(*[named(q, k) for k, q in queries.items()])
    return index.select(F.explode(found).alias("c")).select("c.*").groupBy("_row").agg(F.collect_set("kind").alias("_rules"))


def _has_kind(kind: str) -> Column:
    return F.exists("spans", lambda s: s["kind"] == kind)


def _sum(xs) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _running_sums(xs: Column, block: int = 128) -> Column:
    """Running sums of an array that isn't empty, in blocks so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, block))
    sums = F.transform(blocks, _sum)
    before = F.transform(sums, lambda _, i: _sum(F.slice(sums, F.lit(1), i)))
    return F.flatten(F.zip_with(blocks, before, lambda xs, a: F.transform(xs, lambda _, i: a + _sum(F.slice(xs, F.lit(1), i + 1)))))


SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _spans(rule: Rule, rank: int) -> Column:
    """The spans of a rule from its columns of matches, groups and pieces."""
    m, g, p = (F.col(f"_{c}_{rule.kind}") for c in "mgp")
    sizes = F.transform(m, lambda x: F.length(x).cast("bigint"))
    ends = _running_sums(F.zip_with(F.slice(p, F.lit(1), F.size(m)), sizes, lambda a, n: F.length(a) + n))
    spans = F.zip_with(F.zip_with(ends, sizes, lambda e, n: F.struct((e - n).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), e.alias("end"))), g, lambda s, x: F.struct(s.alias("s"), (F.length(x) >= rule.least).alias("kept")))
    kept = F.transform(F.filter(spans, lambda x: x["kept"]), lambda x: x["s"])
    return F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(kept.cast(SPAN))


def _replaced(text: Column, rule: Rule, by: str) -> Column:
    """The text with each match of the rule that isn't dropped replaced."""
    matches, groups = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    put = F.zip_with(matches, groups, lambda m, g: F.when(F.length(g) >= rule.least, F.lit(by)).otherwise(m))
    return F.array_join(F.zip_with(F.split(text, rule.pattern, -1), put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, text: str = "text", redact: str | None = None) -> DataFrame:
    """Add ``spans``, all matches ordered by start and then by the rules' order.

    A span has start and end (code points, end exclusive) and kind. With
    ``redact``, each match in the text is replaced by that string, one rule
    after the other.
    """
    rows = with_row_id(docs.drop("spans"))  # the scan below and the index see the same numbers
    numbered = rows.select("_row", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = candidates(numbered, rules)
    if found is not None:
        rows = rows.join(small_side(materialise(found, "candidates")), "_row", "left")
    else:
        rows = rows.withColumn("_rules", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    for r in rules:
        able = F.coalesce(F.array_contains("_rules", r.kind), F.lit(False)) if query(r.pattern) else F.lit(True)
        rows = rows.withColumn(f"_m_{r.kind}", F.when(able, F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(0))).otherwise(none))
    for r in rules:
        some = F.size(f"_m_{r.kind}") > 0
        rows = rows.withColumn(f"_some_{r.kind}", some)
    for r in rules:
        some, m = F.col(f"_some_{r.kind}"), F.col(f"_m_{r.kind}")
        rows = rows.withColumn(f"_p_{r.kind}", F.when(some, F.split("_text", r.pattern, -1)).otherwise(none))
        rows = rows.withColumn(f"_m_{r.kind}", F.when(some, m).otherwise(none))
        rows = rows.withColumn(f"_g_{r.kind}", F.when(some, F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(r.group))).otherwise(none) if r.group else F.col(f"_m_{r.kind}"))
    rows = rows.withColumn("spans", F.sort_array(F.concat(*[_spans(r, i) for i, r in enumerate(rules)])))
    if redact is not None:
        clean = F.col("_text")
        for r in rules:
            rows = rows.withColumn("_clean", F.when(_has_kind(r.kind), _replaced(clean, r, redact)).otherwise(clean))
            clean = F.col("_clean")
        rows = rows.withColumn(text, F.when(F.size("spans") > 0, F.col("_clean")).otherwise(F.col(text)))
    keep = [c for c in docs.columns if c != "spans"]
    return rows.select(*keep, "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts, digest of the base spans, and all spans."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in texts are replaced by ``[REDACTED]``; n_chars follows where it is there."""
    clean = scan(stage_input(docs), redact="[REDACTED]")
    out = stage_output(clean, docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n = F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("_others")["n_chars"])
        out = clean.select(*[n.alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col("_others")[c].alias(c) for c in docs.columns])
    return out


def _sql_spans(rule: Rule, rank: int) -> str:
    """DuckDB SQL for the spans of a rule over the view d(r, t)."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT r, {rank} AS rank, '{rule.kind}' AS kind, e - n AS s, e, g FROM (
      SELECT r, n, g, sum(gap + n) OVER (PARTITION BY r ORDER BY i) AS e FROM (
        SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: length(x))) AS n,
               unnest(list_transform(g, lambda x: length(x))) AS g, unnest(list_transform(p[1:len(m)], lambda x: length(x))) AS gap
        FROM (SELECT r, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, regexp_split_to_array(t, '{pattern}') AS p FROM d)
      )
    ) WHERE g >= {rule.least}"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(BASE + EXTRA))}),
j AS (
  SELECT r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS every,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN j USING (r)
"""
