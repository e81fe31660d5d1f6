"""URL filters: host and path rules, and a character language-model ratio.

Method
------
A URL that a rule fits gets the rule's verdict. The others are judged by two
variable-order Markov models of characters, one of the URLs that the rules
accept and one of those they reject. A character's probability after its two
predecessors is smoothed by that after one, and this by that after none
(Witten-Bell), so each model goes as far back as it has seen. The score of a URL
is the difference of its log-likelihoods for each character. It is allowed if
the score reaches a level that is calibrated on decided URLs which the models
haven't learnt from (``HELD_OUT`` of the 16 first digits of their MD5): half way
between the mean scores of the accepted and the rejected ones.

Characters are folded to ``SYMBOLS``, so the models are one array of at most
40**3 numbers for any input, which goes into the plan as one value. Only decided
URLs are taken apart to be counted, pre-aggregated by character triple; a URL's
score is one expression over its characters, without a shuffle or a row number.
All in DataFrame and SQL operations.

Defined cases: a null URL, and one without ``://``, has an empty host and path,
fits no rule and is judged by its folded text like any other; without any
accepted or any rejected URL to learn from, the method allows; with none held
out of either class the level is zero; repeated rows and null ids are judged each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, read_table

#: (verdict, host, path) of the rules; a rule is written host + path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What characters are folded to: letters, one digit, these signs, one symbol for all others, and both ends.
SYMBOLS = LOWER + "0/.-_?=&%#:~^$"
assert len(SYMBOLS) == 40
#: First digits of a folded URL's MD5 that keep it for calibration.
HELD_OUT = "012"

#: The models' smoothed ratio of each character triple in ``grams``, for Spark and DuckDB alike.
RATIO_SQL = """
WITH n2 AS (SELECT substr(g, 2, 2) AS h, sum(acc) AS acc, sum(rej) AS rej FROM {counts} GROUP BY substr(g, 2, 2)),
n1 AS (SELECT substr(h, 2, 1) AS c, sum(acc) AS acc, sum(rej) AS rej FROM n2 GROUP BY substr(h, 2, 1)),
c3 AS (SELECT substr(g, 1, 2) AS k, sum(acc) AS na, sum(rej) AS nr, count_if(acc > 0) AS ta, count_if(rej > 0) AS tr FROM {counts} GROUP BY substr(g, 1, 2)),
c2 AS (SELECT substr(h, 1, 1) AS k, sum(acc) AS na, sum(rej) AS nr, count_if(acc > 0) AS ta, count_if(rej > 0) AS tr FROM n2 GROUP BY substr(h, 1, 1)),
p1 AS (SELECT u.g, (coalesce(n1.acc, 0) + 1e0 / 40e0) / ({na} + 1e0) AS a, (coalesce(n1.rej, 0) + 1e0 / 40e0) / ({nr} + 1e0) AS r
       FROM {grams} u LEFT JOIN n1 ON n1.c = substr(u.g, 3, 1)),
p2 AS (SELECT p1.g, CASE WHEN coalesce(c2.na, 0) = 0 THEN a ELSE (coalesce(n2.acc, 0) + ta * a) / (na + ta) END AS a, CASE WHEN coalesce(c2.nr, 0) = 0 THEN r ELSE (coalesce(n2.rej, 0) + tr * r) / (nr + tr) END AS r
       FROM p1 LEFT JOIN n2 ON n2.h = substr(p1.g, 2, 2) LEFT JOIN c2 ON c2.k = substr(p1.g, 2, 1)),
p3 AS (SELECT p2.g, CASE WHEN coalesce(c3.na, 0) = 0 THEN a ELSE (coalesce(n3.acc, 0) + ta * a) / (na + ta) END AS a, CASE WHEN coalesce(c3.nr, 0) = 0 THEN r ELSE (coalesce(n3.rej, 0) + tr * r) / (nr + tr) END AS r
       FROM p2 LEFT JOIN {counts} n3 ON n3.g = p2.g LEFT JOIN c3 ON c3.k = substr(p2.g, 1, 2))
SELECT g, ln(a) - ln(r) AS ratio FROM p3
"""


def host_and_path(url):
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule_for(host, path, rules=RULES):
    """The longest rule that fits, as a struct of length, rule and verdict; else null."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def folded(url):
    """The URL after its scheme in ``SYMBOLS``, with two marks before and one behind."""
    text = F.translate(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), UPPER, LOWER)
    text = F.regexp_replace(F.translate(text, "123456789", "000000000"), r"[^a-z0/.\-_?=&%#:]", "~")
    return F.concat(F.lit("^^"), text, F.lit("$"))


def _is_held_out(text):
    return F.substring(F.md5(text.cast("binary")), 1, 1).isin(*HELD_OUT)


def train(decided: DataFrame) -> DataFrame:
    """(g, acc, rej): counts of character triples in decided URLs (f, v: folded, and verdict).

    Held-out URLs are left out. At most 40**3 rows; equal URLs are counted
    before they are taken apart.
    """
    urls = decided.where(~_is_held_out(F.col("f"))).groupBy("f", "v").agg(F.count("*").alias("n"))
    grams = urls.select("v", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("f") - 2), lambda i: F.substring(F.col("f"), i, F.lit(3)))).alias("g"))
    return grams.groupBy("g").agg(*[F.sum(F.when(F.col("v") == v, F.col("n")).otherwise(0)).alias(a) for v, a in (("allow", "acc"), ("block", "rej"))])


def _ratio_array(spark, counts: DataFrame):
    """The log ratios of all 40**3 triples by number, as a column that is one value."""
    totals = counts.agg(F.sum("acc").alias("na"), F.sum("rej").alias("nr")).first()
    symbol = F.split(F.lit(SYMBOLS), "")
    one = spark.range(1).select(F.explode(symbol).alias("c")).where("c <> ''")
    pairs = one.select(F.col("c").alias("a")).join(one.select(F.col("c").alias("b")), F.lit(True))  # 40 by 40 by 40: the alphabet, no data
    grams = pairs.join(one, F.lit(True)).select(F.concat("a", "b", "c").alias("g"))
    ratios = spark.sql(RATIO_SQL, counts=counts, grams=grams, na=totals["na"] or 0, nr=totals["nr"] or 0)
    place = lambda k: F.instr(F.lit(SYMBOLS), F.substring("g", k, 1)) - 1
    numbered = ratios.select(((place(1) * 40 + place(2)) * 40 + place(3)).alias("i"), "ratio")
    in_order = numbered.agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("i", "ratio"))), lambda x: x["ratio"].cast("string"))).alias("r"))
    return F.split(F.lit(in_order.first()["r"]), " ").cast("array<double>")  # folded to one value by the optimiser


def mean_ratio(text, ratios):
    """The score of a folded URL: the mean of its triples' log ratios, from left to right."""
    symbol = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    mark = F.lit(SYMBOLS.index("^"))
    start = F.struct(mark.alias("a"), mark.alias("b"), F.lit(0.0).alias("s"))
    summed = F.aggregate(F.slice(symbol, F.lit(3), F.length(text) - 2), start, lambda x, c: F.struct(x["b"].alias("a"), c.alias("b"), (x["s"] + F.get(ratios, (x["a"] * 40 + x["b"]) * 40 + c)).alias("s")))
    return summed["s"] / (F.length(text) - 2)


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule, score (null where a rule decides) and verdict to each row."""
    spark = pages.sparkSession
    made = ("host", "path", "rule", "score", "verdict")
    host, path = host_and_path(F.col(url))
    keep = [c for c in pages.columns if c not in made]
    rows = pages.select(*keep, host.alias("host"), path.alias("path"), folded(F.col(url)).alias("_f")).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    decided = materialise(rows.where("_rule is not null").select(F.col("_f").alias("f"), F.col("_rule.verdict").alias("v")), "decided")
    counts = materialise(train(decided), "triples")
    learnt = counts.agg(F.coalesce(F.sum("acc"), F.lit(0)).alias("acc"), F.coalesce(F.sum("rej"), F.lit(0)).alias("rej")).first()
    if not learnt["acc"] or not learnt["rej"]:
        score, by_score = F.lit(None).cast("double"), F.lit("allow")
    else:
        ratios = _ratio_array(spark, counts)
        scored = decided.where(_is_held_out(F.col("f"))).select("v", mean_ratio(F.col("f"), ratios).alias("s"))
        means = scored.agg(*[F.avg(F.when(F.col("v") == v, F.col("s"))).alias(v) for v in ("allow", "block")]).first()
        level = 0.0 if None in tuple(means) else (means["allow"] + means["block"]) / 2
        score = F.when(F.col("_rule").isNull(), mean_ratio(F.col("_f"), ratios))
        by_score = F.when(F.round(F.col("score") - F.lit(level), 9) >= 0, "allow").otherwise("block")
    out = rows.withColumn("score", score)
    return out.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), "score", F.coalesce("_rule.verdict", by_score).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_CASES = ", ".join(f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{n: {len(h + p)}, rule: '{h}{p}', verdict: '{v}'}} END" for v, h, p in RULES)
OP9_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT r, page_id, url, translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS (SELECT *, list_max(list_filter([{_CASES}], lambda x: x IS NOT NULL)) AS w FROM h),
f AS (SELECT r, w.verdict AS verdict, '^^' || regexp_replace(translate(translate(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '{UPPER}', '{LOWER}'), '123456789', '000000000'), '[^a-z0/.\\-_?=&%#:]', '~', 'g') || '$' AS f FROM v),
x AS (SELECT r, verdict, left(md5(f), 1) IN ({", ".join(f"'{c}'" for c in HELD_OUT)}) AS held, f, unnest(range(1, length(f) - 1)) AS i FROM f),
grams0 AS (SELECT r, verdict, held, substr(f, i, 3) AS g, count(*) AS n FROM x GROUP BY ALL),
every AS (SELECT DISTINCT g FROM grams0),
counts AS (SELECT g, sum(CASE WHEN verdict = 'allow' THEN n ELSE 0 END) AS acc, sum(CASE WHEN verdict = 'block' THEN n ELSE 0 END) AS rej FROM grams0 WHERE verdict IS NOT NULL AND NOT held GROUP BY g),
ratios AS ({RATIO_SQL.format(counts="counts", grams="every", na="(SELECT sum(acc) FROM counts)", nr="(SELECT sum(rej) FROM counts)")}),
scores AS (SELECT r, verdict, held, sum(n * ratio) / sum(n) AS s FROM grams0 JOIN ratios USING (g) GROUP BY r, verdict, held),
level AS (SELECT CASE WHEN (SELECT coalesce(sum(acc), 0) * coalesce(sum(rej), 0) FROM counts) = 0 THEN '-Infinity'::DOUBLE
                 ELSE coalesce((avg(s) FILTER (verdict = 'allow' AND held) + avg(s) FILTER (verdict = 'block' AND held)) / 2, 0) END AS t FROM scores)
SELECT page_id, host, path, w.rule AS rule,
       coalesce(w.verdict, CASE WHEN coalesce(round(s - (SELECT t FROM level), 9), 0) >= 0 THEN 'allow' ELSE 'block' END) AS verdict
FROM v LEFT JOIN scores USING (r)
"""
