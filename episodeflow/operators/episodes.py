"""Episode algebra: flags, lengths, rewards, pooling and the shapes of a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EP = "episode_id"


def ticks(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """Add t, the place of each row in its episode from 0 on."""
    return rows.withColumn("t", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("bigint"))


def boundary_flags(steps: DataFrame, terminated: str = "terminated", truncated: str = "truncated", by: str = EP, order: str = "t") -> DataFrame:
    """Add is_first (start, or the step before ended) and is_last (ends, or is the last)."""
    w = Window.partitionBy(by).orderBy(order)
    ends = F.col(terminated) | F.col(truncated)
    return steps.withColumn("is_first", F.coalesce(F.lag(ends).over(w), F.lit(True))).withColumn("is_last", ends | F.lead(F.lit(1)).over(w).isNull())


def wall_time(t: Column, tick_hz: float) -> Column:
    return t / F.lit(float(tick_hz))


def total_reward(steps: DataFrame, reward: str = "reward", by: str = EP) -> DataFrame:
    return steps.groupBy(by).agg(F.coalesce(F.sum(reward), F.lit(0.0)).alias("total_reward"))


def lengths(steps: DataFrame, by: str = EP, order: str = "t") -> DataFrame:
    return steps.groupBy(by).agg((F.max(order) + 1).alias("length_t"), F.count("*").alias("n_steps"))


def reward_summary(steps: DataFrame, reward: str = "reward", done: str = "done", by: str = EP) -> DataFrame:
    return steps.groupBy(by).agg(F.avg(reward).alias("mean_reward"), F.count_if(F.col(done)).alias("n_terminal"))


def mean_pool(steps: DataFrame, value: str, by: tuple[str, ...] = (EP,)) -> DataFrame:
    """The mean of each dimension of an array column over an episode, as an array."""
    dims = steps.select(*by, F.posexplode(value).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("m"))
    return dims.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("embedding"))


def window_pool(steps: DataFrame, value: str, window: int = 32, stride: int = 16, by: str = EP, order: str = "t") -> DataFrame:
    """Means over sliding windows: (episode, window_start, window_end, embedding, window_id).

    Windows start at 0, stride, ... while they fit; a shorter episode has one
    window; what follows the last full window isn't pooled. Each step is dealt
    to the windows that cover it, so no range join is needed.
    """
    # a window [s, s + window) covers t for s from t - window + 1 to t
    first = F.greatest(F.lit(0), F.ceil((F.col(order) - window + 1) / stride)).cast("bigint")
    last = F.floor(F.col(order) / stride).cast("bigint")
    n = F.max(order).over(Window.partitionBy(by)) + 1
    rows = steps.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("window_start", F.col("_k") * stride)
    rows = rows.where((F.col("window_start") <= F.col(order)) & (F.col("window_start") < F.greatest(F.col("_n") - window + 1, F.lit(1))))
    dims = rows.select(by, "window_start", F.least(F.col("window_start") + window, F.col("_n")).alias("window_end"), F.posexplode(value).alias("dim", "x"))
    means = dims.groupBy(by, "window_start", "window_end", "dim").agg(F.avg("x").alias("m"))
    pooled = means.groupBy(by, "window_start", "window_end").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("embedding"))
    return pooled.withColumn("window_id", F.concat(F.col(by).cast("string"), F.lit("_w"), F.col("window_start").cast("string")))


def to_episodic(steps: DataFrame, columns: list[str], by: str = EP, order: str = "t") -> DataFrame:
    """One row for each episode; each column becomes an array in step order."""
    held = F.sort_array(F.collect_list(F.struct(order, *columns)))
    rows = steps.groupBy(by).agg(held.alias("_s"))
    pick = lambda c: F.transform("_s", lambda s: s[c]).alias(c)
    return rows.select(by, F.size("_s").alias("length"), *[pick(c) for c in columns])


def from_episodic(episodes: DataFrame, columns: list[str], by: str = EP) -> DataFrame:
    """One row for each step of episodes of arrays; the step number is t."""
    zipped = F.arrays_zip(*columns)
    rows = episodes.select(by, F.posexplode(zipped).alias("t", "_s"))
    return rows.select(by, F.col("t").cast("bigint").alias("t"), *[F.col("_s")[c].alias(c) for c in columns])


def episodic_length(length: Column, first: Column) -> Column:
    """The stated length, or that of the first array where none is stated."""
    return F.coalesce(F.nullif(length, F.lit(0)), F.size(first))


def flatten_names(steps: DataFrame, obs: dict[str, str], actions: dict[str, str]) -> DataFrame:
    """One row for each step with columns obs_* and action_*; slashes become underscores."""
    named = lambda prefix, m: [F.col(c).alias(f"{prefix}_{n.replace('/', '_')}") for n, c in m.items()]
    rest = [c for c in (EP, "t", "reward", "terminated", "truncated") if c in steps.columns]
    return steps.select(*rest, *named("obs", obs), *named("action", actions)).withColumnRenamed("t", "timestep")


def flat_export(steps: DataFrame, state: str, state_dim: int, action: str, action_dim: int, fps: float) -> DataFrame:
    """The flat layout with a column for each dimension, indices and a timestamp."""
    return steps.select(
        *[F.get(state, F.lit(i)).alias(f"observation.state.{i}") for i in range(state_dim)],
        *[F.get(action, F.lit(i)).alias(f"action.{i}") for i in range(action_dim)],
        F.col("done").alias("next.done"), F.col(EP).alias("episode_index"), F.col("t").alias("frame_index"), (F.col("t") / F.lit(float(fps))).alias("timestamp"),
    )


def dataset_metadata(episodes: DataFrame, length: str, keys: str, has_rewards: str, order: str = EP) -> DataFrame:
    """One row: episodes, steps, the first episode's channels and whether all have rewards."""
    return episodes.agg(F.count("*").alias("num_episodes"), F.sum(length).alias("total_timesteps"), F.min_by(keys, order).alias("observation_keys"), F.min_by(has_rewards, order).alias("has_rewards"))


def metadata_filter(env_id=None, min_length=None, min_reward=None, max_reward=None) -> Column | None:
    """The conjunction of the filters that are given; None without any."""
    parts = [
        None if env_id is None else F.col("env_id") == env_id,
        None if min_length is None else F.col("length_t") >= min_length,
        None if min_reward is None else F.col("total_reward") >= min_reward,
        None if max_reward is None else F.col("total_reward") <= max_reward,
    ]
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def slice_steps(steps: DataFrame, start: int, end: int, order: str = "t") -> DataFrame:
    """The steps of [start, end), counted from 0 again."""
    return steps.where((F.col(order) >= start) & (F.col(order) < end)).withColumn(order, F.col(order) - start)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest_episodes(corpus: DataFrame, query: list[float], k: int, where: Column | None = None, vector: str = "embedding", key: str = EP) -> DataFrame:
    """The k rows of largest cosine to a stated vector, ties to the smaller key.

    The vector is a literal; each partition keeps its own best k.
    """
    rows = corpus if where is None else corpus.where(where)
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def reshape(flat: Column, width: int) -> Column:
    """A flat array as an array of rows of ``width``."""
    rows = F.sequence(F.lit(0), (F.size(flat) / width).cast("int") - 1)
    return F.when(F.size(flat) < width, F.array().cast("array<array<double>>")).otherwise(F.transform(rows, lambda i: F.slice(flat, i * width + 1, width).cast("array<double>")))


def embed(pooled: DataFrame, function=None, vector: str = "embedding") -> DataFrame:
    """Apply a user's function of one vector to each; without one they stay as they are."""
    if function is None:
        return pooled

    @F.pandas_udf("array<double>")
    def of(s):
        import numpy as np

        return s.map(lambda v: None if v is None else np.asarray(function(np.asarray(v, np.float64)), np.float64))

    return pooled.withColumn(vector, of(F.col(vector)))
