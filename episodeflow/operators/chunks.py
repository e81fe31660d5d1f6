"""Chunks of long episodes: assignment, manifests, continuity and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import chunk_name

EP = "episode_id"


def assign_chunks(steps: DataFrame, size: int, by: str = EP, order: str = "t") -> DataFrame:
    return steps.withColumn("chunk_index", F.floor(F.col(order) / size).cast("bigint"))


def map_chunks(steps: DataFrame, size: int, function, schema: str, by: str = EP, order: str = "t") -> DataFrame:
    """Apply ``function`` to each chunk of an episode, a pandas frame in order of its steps.

    It gets the key (episode, chunk_index) and the frame, and returns a frame of
    ``schema``. A task holds one chunk at a time, however long the episode is.
    """

    def run(key, frame):
        return function(key, frame.sort_values(order, kind="stable", ignore_index=True))

    return assign_chunks(steps, size, by, order).groupBy(by, "chunk_index").applyInPandas(run, schema)


def manifest(steps: DataFrame, size: int, by: str = EP, order: str = "t", suffix: str = "bin") -> DataFrame:
    """One row for each chunk, with its inclusive range of steps."""
    chunks = assign_chunks(steps, size, by, order).groupBy(by, "chunk_index").agg(F.min(order).alias("t_start"), F.max(order).alias("t_end"), F.count("*").alias("length_t"))
    total = F.count("*").over(Window.partitionBy(by))
    return chunks.withColumn("total_chunks", total).withColumn("uri", chunk_name(F.col(by), F.col("chunk_index"), suffix))


def manifest_totals(chunks: DataFrame, by: str = EP) -> DataFrame:
    return chunks.groupBy(by).agg(F.count("*").alias("total_chunks"), F.sum("length_t").alias("total_timesteps"))


def manifest_json(chunks: DataFrame, by: str = EP) -> DataFrame:
    """One JSON manifest for each episode."""
    held = F.sort_array(F.collect_list(F.struct("chunk_index", "uri", "t_start", "t_end", "length_t")))
    grouped = chunks.groupBy(by).agg(held.alias("chunks"), F.sum("length_t").alias("total_timesteps"))
    return grouped.select(by, F.to_json(F.struct(F.col(by), F.size("chunks").alias("total_chunks"), "total_timesteps", "chunks")).alias("manifest"))


def read_manifest(manifests: DataFrame, column: str = "manifest", id_type: str = "bigint", by: str = EP) -> DataFrame:
    """The chunks of JSON manifests, a row each."""
    kind = f"{by} {id_type}, total_chunks bigint, total_timesteps bigint, chunks array<struct<chunk_index:bigint,uri:string,t_start:bigint,t_end:bigint,length_t:bigint>>"
    return manifests.select(F.from_json(column, kind).alias("m")).select(F.col(f"m.{by}"), F.explode("m.chunks").alias("c")).select(by, "c.*")


def continuity_errors(chunks: DataFrame, stated: DataFrame | None = None, by: str = EP) -> DataFrame:
    """(episode, rule) of the rules that a manifest breaks: index, range and total.

    Indices must run from 0 without gap or repeat, each range must start after
    the one before, and lengths must add up to ``stated`` (episode,
    total_timesteps). An episode without chunks breaks none.
    """
    w = Window.partitionBy(by).orderBy("chunk_index", "t_start")
    rows = chunks.withColumn("_place", F.row_number().over(w) - 1).withColumn("_before", F.lag("t_end").over(w))
    rules = rows.groupBy(by).agg(F.bool_or(F.col("chunk_index") != F.col("_place")).alias("index"), F.coalesce(F.bool_or(F.col("t_start") != F.col("_before") + 1), F.lit(False)).alias("range"), F.sum("length_t").alias("_sum"))
    total = F.lit(False)
    if stated is not None:
        rules = rules.join(stated, by, "left")
        total = F.coalesce(F.col("_sum") != F.col("total_timesteps"), F.lit(False))
    broken = F.array_compact(F.array(F.when(F.col("index"), "index"), F.when(F.col("range"), "range"), F.when(total, "total")))
    return rules.select(by, F.explode(broken).alias("rule"))


def check_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with sha_ok: whether the file of their uri has their SHA-256; false where it is missing."""
    found = files.select("uri", F.sha2("content", 256).alias("_sha"))
    return chunks.join(found, "uri", "left").withColumn("sha_ok", F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(False))).drop("_sha")
