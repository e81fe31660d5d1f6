"""Getters and joins over long steps (episode_id, lane, channel, model_id, t, value) and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import MODALITIES, block_name


def lane_steps(steps: DataFrame, lane: str, channel: str | None = None, model_id: str | None = None) -> DataFrame:
    """The steps of one lane, of a channel and of the model that made them where these are stated."""
    wanted = F.col("lane") == lane
    for column, value in (("channel", channel), ("model_id", model_id)):
        if value is not None:
            wanted &= F.col(column) == value
    return steps.where(wanted)


def modality_steps(rows: DataFrame, group: str | None = None, modality: str | None = None) -> DataFrame:
    """The rows of a group, of a modality or of both; a channel is ``group/modality``."""
    channel = F.col("channel")
    if group is not None:
        rows = rows.where(F.substring_index(channel, "/", 1) == group)
    if modality is not None:
        rows = rows.where(F.contains(channel, F.lit("/")) & (F.substring_index(channel, "/", -1) == modality))
    return rows


def add_observation(steps: DataFrame, observed: DataFrame, group: str, modality: str) -> DataFrame:
    """Steps with those of one more observation (episode_id, t, value) as ``group/modality`` of the signal lane."""
    more = observed.select("episode_id", F.lit("signal").alias("lane"), F.lit(f"{group}/{modality}").alias("channel"), "t", "value")
    return steps.select(*more.columns).unionByName(more)


def known_modality(modality: Column) -> Column:
    """A modality that is known; null for any other."""
    return F.when(modality.isin(*MODALITIES), modality)


LATENT_ACTIONS = "latent_action_codebook"


def latent_actions(steps: DataFrame, code: str, model_id: str) -> DataFrame:
    """A model's latent action codes as steps of the omen lane: (episode_id, t, name, code)."""
    return steps.select("episode_id", "t", block_name("omen", F.lit(LATENT_ACTIONS), F.lit(model_id)).alias("name"), F.col(code).alias("code"))


def prediction_errors(steps: DataFrame, channel: str, model_id: str) -> DataFrame:
    """Signal less prediction of a channel, where both are there: (episode_id, t, error).

    Both lanes meet in one aggregate by step, so neither is joined with the other.
    """
    of = lambda c: F.max(F.when(c, F.col("value")))
    both = steps.where((F.col("channel") == channel) & ((F.col("lane") == "signal") | (F.col("lane") == "omen") & (F.col("model_id") == model_id)))
    pair = both.groupBy("episode_id", "t").agg(of(F.col("lane") == "signal").alias("s"), of(F.col("lane") == "omen").alias("o"))
    return pair.where("s is not null and o is not null").select("episode_id", "t", (F.col("s") - F.col("o")).alias("error"))


def scaled(steps: DataFrame, scales: DataFrame, q: str = "q", scale: str = "scale") -> DataFrame:
    """Quantised steps with the scale of their window: adds ``deviation``. ``scales`` has one row for each episode and win."""
    joined = steps.drop(scale).join(scales.select("episode_id", "win", scale), ["episode_id", "win"])
    return joined.withColumn("deviation", F.col(q) * F.col(scale))


def with_tag(rows: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    """The rows that have a tag."""
    return rows.where(F.array_contains(tags, tag))


def vector_rows(vectors: DataFrame, episode: str, env: str, embedding: str, folder: str, suffix: str = ".bin") -> DataFrame:
    """Vectors as rows of a collection: (episode_id, env_id, file_path, dim, embedding)."""
    path = F.concat(F.lit(f"{folder}/"), F.col(episode).cast("string"), F.lit(suffix))
    return vectors.select(F.col(episode).alias("episode_id"), F.col(env).alias("env_id"), path.alias("file_path"), F.size(embedding).alias("dim"), F.col(embedding).alias("embedding"))


def hit_episodes(hits: DataFrame, episodes: DataFrame, key: str = "episode_id") -> DataFrame:
    """Search hits with their episodes' own columns. ``hits`` are the k rows of a search, so they are broadcast."""
    return episodes.join(F.broadcast(hits), key)


def flat_name(name: Column) -> Column:
    """A block name without slashes. This can't be undone: keep the name beside it."""
    return F.translate(name, "/", "_")


def metadata_value(metadata: Column, *keys: str) -> Column:
    """The first of the keys that a JSON object has, as a string; older names of a key go last."""
    return F.coalesce(*[F.get_json_object(metadata, f"$.{k}") for k in keys])


def tick_rate(episode_hz: Column, file_hz: Column, default: float = 30.0) -> Column:
    """Ticks a second: the episode's own, else its file's, else the default."""
    return F.coalesce(episode_hz, file_hz, F.lit(default))


def sorted_names(blocks: DataFrame, limit: int | None = None, name: str = "name") -> DataFrame:
    """The distinct block names in order, the first ``limit`` of them where stated."""
    names = blocks.select(name).distinct().orderBy(name)
    return names if limit is None else names.limit(limit)


def has_entry(blocks: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Each of ``names`` with its number of entries and the size of the first, null without any."""
    found = blocks.groupBy(name).agg(F.count("*").alias("n_entries"), F.min_by("orig_size", "entry_idx").alias("size"))
    return names.join(found, name, "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0))).withColumn("has", F.col("n_entries") > 0)


def channel_definitions(metadata: DataFrame, file: str = "file", text: str = "metadata") -> DataFrame:
    """The channels of ``meta/channels`` documents: (file, id, dtype, shape, modality, signal_block)."""
    kind = "channels array<struct<id:string,dtype:string,shape:array<int>,modality:string,signal_block:string>>"
    rows = metadata.select(file, F.explode(F.from_json(text, kind)["channels"]).alias("c"))
    return rows.select(file, "c.id", "c.dtype", "c.shape", known_modality(F.col("c.modality")).alias("modality"), F.coalesce("c.signal_block", F.concat(F.lit("signal/"), "c.id")).alias("signal_block"))


#: Fixed value: the flag of a block that is stored in chunks.
FLAG_CHUNKED = 0x8


def is_chunked(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(FLAG_CHUNKED)) != 0


def is_compressed(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(0x1)) != 0


def checked_int(value: Column, bits: int = 32) -> Column:
    """An unsigned 64-bit number (decimal(20,0)) as a signed one of so many bits; null beyond its range."""
    return F.when((value >= 0) & (value <= F.lit(2 ** (bits - 1) - 1)), value).try_cast("int" if bits == 32 else "bigint")
