"""Catalog and schema operators over block names and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import glob_regex, region_of, under_prefix


def children(blocks: DataFrame, prefix: str, name: str = "name", ordinal: str = "entry_idx") -> DataFrame:
    """The distinct next parts below a prefix, in the order of their first entry."""
    rest = F.col(name) if not prefix else F.expr(f"substring({name}, {len(prefix) + 2})")
    below = blocks.where(under_prefix(F.col(name), prefix) & (F.col(name) != prefix))
    return below.groupBy(F.substring_index(rest, "/", 1).alias("child")).agg(F.min(ordinal).alias("first_entry"))


def modality_groups(channels: DataFrame) -> DataFrame:
    """Channels by group: the first part of a channel of several parts, else ``default``."""
    grp = F.when(F.contains("channel", F.lit("/")), F.substring_index("channel", "/", 1)).otherwise("default")
    return channels.groupBy(grp.alias("grp")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "channel", "modality"))), ",").alias("members"))


def region_groups(tensors: DataFrame, name: str = "name") -> DataFrame:
    region = region_of(F.col(name))
    label = F.when(F.col("region") == 0, "embeddings").when(F.col("region") == 65535, "output").otherwise(F.concat(F.lit("layer_"), (F.col("region") - 1).cast("string")))
    return tensors.groupBy(region.alias("region")).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("tensors")).withColumn("label", label)


def block_summary(blocks: DataFrame) -> DataFrame:
    n = F.count_if(F.col("disk_size") < F.col("orig_size"))
    return blocks.agg(F.count("*").alias("n_blocks"), n.alias("n_compressed"), F.sum("orig_size").alias("orig_size"), F.sum("disk_size").alias("disk_size"), (F.sum("orig_size") / F.sum("disk_size")).alias("ratio"))


def schema_id(entries: DataFrame, tags: list[str]) -> DataFrame:
    """The first 16 hex digits of the SHA-256 of the tags and the sorted entries, joined by NUL."""
    line = F.concat_ws("\0", "name", "content_type", "semantic_type")
    body = F.concat_ws("\0", F.array(*[F.lit(t) for t in tags]), F.sort_array(F.collect_list(line)))
    return entries.agg(F.substring(F.sha2(body.cast("binary"), 256), 1, 16).alias("schema_id"))


def match_specs(tensors: DataFrame, specs: list[tuple[str, str | None, list[int] | None, bool]], name: str = "name") -> DataFrame:
    """Each tensor with the place of the first spec whose glob fits its name; null without one.

    ``specs`` are (glob, dtype or None, shape with -1 for any or None, optional).
    They are a stated list, so their patterns are expressions of one pass.
    """
    fits = [F.when(F.col(name).rlike(f"^(?:{glob_regex(p)})$"), F.lit(i)) for i, (p, *_) in enumerate(specs)]
    return tensors.withColumn("spec", F.coalesce(*fits) if fits else F.lit(None).cast("int"))


def schema_errors(tensors: DataFrame, specs: list, name: str = "name", dtype: str = "dtype", shape: str = "shape") -> DataFrame:
    """(tensor_name, message) for wrong dtypes, ranks and dimensions and for missing tensors.

    Of a tensor's dimensions the first wrong one is reported.
    """
    spark = tensors.sparkSession
    matched = match_specs(tensors, specs, name)

    def errors(i: int) -> Column:
        _, want, dims, _ = specs[i]
        out = []
        if want:
            out.append(F.when(F.col(dtype) != want, F.concat(F.lit(f"dtype {want} wanted, is "), F.col(dtype))))
        if dims is not None:
            out.append(F.when(F.size(shape) != len(dims), F.concat(F.lit(f"rank {len(dims)} wanted, is "), F.size(shape).cast("string"))))
            wrong = F.coalesce(*[F.when(F.get(shape, F.lit(j)) != d, F.lit(f"dimension {j} of {d} wanted")) for j, d in enumerate(dims) if d >= 0], F.lit(None).cast("string"))
            out.append(F.when(F.size(shape) == len(dims), wrong))
        return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")

    told = F.array().cast("array<string>")
    for i in reversed(range(len(specs))):
        told = F.when(F.col("spec") == i, errors(i)).otherwise(told)
    wrong = matched.select(F.col(name).alias("tensor_name"), F.explode(told).alias("message"))
    needed = spark.createDataFrame([(i, s[0]) for i, s in enumerate(specs) if not s[3]], "spec int, tensor_name string")
    missing = needed.join(matched.where("spec is not null").select("spec").distinct(), "spec", "left_anti").select("tensor_name", F.lit("required tensor is missing").alias("message"))
    return wrong.unionByName(missing)


def tag_position(dictionary: list[str], tag: str) -> int:
    """The bit of a tag in a dictionary of up to 16; -1 where it isn't there."""
    return dictionary.index(tag) if tag in dictionary[:16] else -1


def add_tag(tags: Column, tag: str) -> Column:
    """Append a tag once."""
    return F.when(F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, F.lit(tag)))


def unlisted(blocks: DataFrame, listed: DataFrame, name: str = "name") -> DataFrame:
    """Listed blocks that are there, and blocks of data lanes that no list has."""
    there = blocks.join(listed.select(name).distinct(), name, "left_semi").withColumn("listed", F.lit(True))
    rest = blocks.where(F.substring_index(name, "/", 1).isin("signal", "action")).join(listed.select(name).distinct(), name, "left_anti").withColumn("listed", F.lit(False))
    return there.unionByName(rest)


def episode_errors(episodes: DataFrame, channel_lengths: DataFrame) -> DataFrame:
    """(episode_id, rule) that an episode breaks.

    ``episodes``: episode_id, length_t and, for chunks, chunk_index, total_chunks,
    t_start and t_end; ``channel_lengths``: episode_id, channel, n.
    """
    chunked = F.col("chunk_index").isNotNull()
    rules = {
        "id": F.coalesce(F.col("episode_id").cast("string"), F.lit("")) == "",
        "length": F.coalesce(F.col("length_t"), F.lit(0)) <= 0,
        "chunk_total": chunked & (F.coalesce(F.col("total_chunks"), F.lit(0)) <= 0),
        "chunk_index": chunked & ((F.col("chunk_index") < 0) | (F.col("chunk_index") >= F.col("total_chunks"))),
        "chunk_range": chunked & (F.col("t_start").isNull() | F.col("t_end").isNull() | (F.col("t_start") > F.col("t_end"))),
    }
    own = episodes.select("episode_id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))).alias("rule"))
    lengths = channel_lengths.join(episodes.select("episode_id", "length_t"), "episode_id").where("n <> length_t").select("episode_id", F.concat(F.lit("channel_length:"), "channel").alias("rule"))
    return own.unionByName(lengths)


def writer_errors(blocks: DataFrame, by: str = "episode_id", name: str = "name") -> DataFrame:
    """(episode, rule) of what a container's writer needs and an episode lacks."""
    has = lambda c: F.bool_or(c)
    lane = F.substring_index(name, "/", 1)
    rows = blocks.groupBy(by).agg(*[has(lane == x).alias(x) for x in ("time", "action", "signal")], has(F.col(name) == "done").alias("done"))
    return rows.select(by, F.explode(F.array_compact(F.array(*[F.when(~F.col(x), x) for x in ("time", "done", "action", "signal")]))).alias("rule"))


def step_errors(steps: DataFrame, shapes: dict[str, int], max_steps: int, order: str = "t") -> DataFrame:
    """Steps that a recorder refuses, with the rule: unknown channel, size, or too many steps."""
    known = F.col("channel").isin(*shapes)
    size = F.element_at(F.create_map(*[F.lit(x) for kv in shapes.items() for x in kv]), F.col("channel"))
    rule = F.when(~known, "channel").when(F.size("value") != size, "shape").when(F.col(order) >= max_steps, "max_timesteps")
    return steps.withColumn("rule", rule).where(F.col("rule").isNotNull())


def first_by_name(names: DataFrame, ordinal: str = "entry_idx") -> DataFrame:
    """Of entries with one name the first, as a lookup by name finds it."""
    w = Window.partitionBy("name").orderBy(ordinal)
    return names.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def map_names(tensors: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Tensors with the source name of their canonical name and the other way; null where no map has it.

    ``names`` (canon, source) is a stated table and joined by key.
    """
    source = names.select(F.col("canon").alias(name), F.col("source").alias("source_name"))
    canon = names.select(F.col("source").alias(name), F.col("canon").alias("canon_name"))
    return tensors.join(source, name, "left").join(canon, name, "left")


def join_channels(blocks: DataFrame, channels: DataFrame) -> DataFrame:
    """Blocks with the dtype of their channel, found by short id and else by full name."""
    short = channels.select(F.concat(F.lit("signal/"), "id").alias("name"), F.col("dtype").alias("_short")).dropDuplicates(["name"])
    full = channels.select(F.col("id").alias("name"), F.col("dtype").alias("_full")).dropDuplicates(["name"])
    found = blocks.join(short, "name", "left").join(full, "name", "left")
    return found.withColumn("dtype", F.coalesce("_short", "_full")).drop("_short", "_full")


def list_files(files: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """File names in order, of stated ids, the first ``limit`` of them."""
    from ..functions.names import file_stem

    rows = files if ids is None else files.where(file_stem(F.col("path")).isin(ids))
    rows = rows.orderBy("path")
    return rows if limit is None else rows.limit(limit)
