"""Episode views over the relational test tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.episodes import ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(spark, d) -> DataFrame:
    """Events as steps: an episode for each user, ordered by time."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("episode_id"), "ts", "event_id", "event_type", F.col("value").alias("x"))
    rows = ticks(rows, "episode_id", "ts", "event_id")
    return rows.withColumn("terminated", F.col("event_type") == "error").withColumn("truncated", F.col("event_type") == "logout")


def item_steps(spark, d) -> DataFrame:
    """Order lines as steps of four dimensions: an episode for each order."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), "l_linenumber", "l_partkey", "l_suppkey", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v"))
    return ticks(rows, "episode_id", "l_linenumber", "l_partkey", "l_suppkey")


def predicted_steps(spark, d) -> DataFrame:
    """Event steps with a prediction (omen): the mean of the three values before, at first the value itself."""
    w = Window.partitionBy("episode_id").orderBy("t")
    a, b, c = (F.lag("x", i).over(w) for i in (1, 2, 3))
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int") + c.isNotNull().cast("int")
    mean = (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)) + F.coalesce(c, F.lit(0.0))) / n
    return event_steps(spark, d).withColumn("omen", F.when(a.isNull(), F.col("x")).otherwise(mean))


def blocks(spark, d) -> DataFrame:
    """A catalog of block names: one for each event, by its type."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("entry_idx"), "event_type", "user_id")
    lane = F.element_at(F.array(*[F.lit(x) for x in ("signal", "action", "omen", "meta", "residual")]), (F.col("entry_idx") % 5 + 1).cast("int"))
    name = F.concat_ws("/", lane, F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")), "event_type")
    return rows.select("entry_idx", name.alias("name"), (F.col("entry_idx") * 40503 % 2147483647).cast("bigint").alias("reserved"), (F.col("entry_idx") % 16).cast("int").alias("flags"), (F.col("entry_idx") % 3).cast("int").alias("default_codec"), (F.col("entry_idx") % 300).alias("orig_size"), (F.col("entry_idx") * 7 % 300).alias("disk_size"))


#: The views in DuckDB's SQL, as common table expressions.
EV = """ev AS (SELECT user_id AS episode_id, ts, event_id, event_type, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
        event_type = 'error' AS terminated, event_type = 'logout' AS truncated FROM events)"""
LI = """li AS (SELECT l_orderkey AS episode_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS t,
        [l_quantity, l_extendedprice, l_discount, l_tax] AS v FROM lineitem)"""
OM = EV + """, om0 AS (SELECT *, lag(x, 1) OVER w AS a, lag(x, 2) OVER w AS b, lag(x, 3) OVER w AS c FROM ev WINDOW w AS (PARTITION BY episode_id ORDER BY t)),
        om AS (SELECT *, CASE WHEN a IS NULL THEN x ELSE (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) END AS omen FROM om0)"""
BL = """bl AS (SELECT event_id AS entry_idx, ['signal', 'action', 'omen', 'meta', 'residual'][event_id % 5 + 1] || '/c' || (user_id % 7) || '/' || event_type AS name,
        (event_id * 40503 % 2147483647)::BIGINT AS reserved, (event_id % 16)::INT AS flags, (event_id % 3)::INT AS default_codec, event_id % 300 AS orig_size, event_id * 7 % 300 AS disk_size FROM events)"""
