"""Recording episodes from a stream of steps.

A step has episode_id, t, channel, value, reward and done. Steps of an episode
are gathered as keyed state and put there ``flush_steps`` at a time, so a step costs
the same however long its episode is; an episode is given out whole when its last
step (done) has come, and never before. A step of the channel ``ABORT`` throws away
what its episode has gathered. A restarted query goes on from its checkpoint, and the
sinks show whole episodes only: ``write_episodes`` by the commit log of its Parquet
files, ``write_containers`` by container files that get their name when complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "episode_id string, t bigint, channel string, value array<double>, reward double, done boolean, ts timestamp"
EPISODE = "episode_id string, status string, length bigint, total_reward double, ts array<bigint>, rewards array<double>, values array<array<double>>, channels array<string>"
#: The channel of a step that aborts its episode.
ABORT = "__abort__"


def read_steps(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the step files of a folder, in Parquet."""
    return spark.readStream.schema(STEP).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def split_valid(steps: DataFrame, shapes: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Steps that may be recorded, and refused ones with the rule that they break."""
    size = F.element_at(F.create_map(*[F.lit(x) for kv in shapes.items() for x in kv]), F.col("channel"))
    rule = F.when(F.col("channel").isNull() | ~F.col("channel").isin(*shapes), "channel").when(F.size("value") != size, "shape")
    told = steps.withColumn("rule", F.when(F.col("channel").eqNullSafe(ABORT), None).otherwise(rule))
    return told.where("rule is null").drop("rule"), told.where("rule is not null")


def record(steps: DataFrame, max_steps: int = 100_000, flush_steps: int = 64) -> DataFrame:
    """One row for each finished episode, its steps in order of t.

    An episode of more than ``max_steps`` steps is given out with the status
    ``too_long`` and none of them, an aborted one with the status ``aborted`` and
    none; steps after an episode's end begin it anew. Of one batch, steps are taken
    in order of t, an abort after the others of its t. The session must use a state
    store of its own files (RocksDB).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Recorder(StatefulProcessor):
        def init(self, handle):
            self.steps = handle.getListState("steps", "t bigint, reward double, value array<double>, channel string")
            self.count = handle.getValueState("count", "n bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            n = self.count.get()[0] if self.count.exists() else 0
            out, waiting = [], []

            def flush():
                if waiting:
                    self.steps.appendList(waiting)
                    waiting.clear()

            def close(status: str, held: list):
                rewards = [s[1] for s in held]
                out.append((key[0], status, n, sum(rewards), [s[0] for s in held], rewards, [list(s[2]) for s in held], [s[3] for s in held]))
                waiting.clear()
                self.steps.clear()

            for pdf in rows:
                pdf = pdf.assign(aborts=pdf["channel"] == ABORT).sort_values(["t", "aborts"], kind="stable")
                for r in pdf.itertuples(index=False):
                    if r.aborts:
                        close("aborted", [])
                        n = 0
                        continue
                    n += 1
                    if n <= max_steps:
                        waiting.append((int(r.t), float(r.reward), [float(x) for x in r.value], r.channel))
                        if len(waiting) >= flush_steps:
                            flush()
                    if r.done:
                        flush()
                        kept = n <= max_steps
                        close("done" if kept else "too_long", sorted(self.steps.get(), key=lambda s: s[0]) if kept and self.steps.exists() else [])
                        n = 0
            flush()
            self.count.update((n,))
            if out:
                yield pd.DataFrame(out, columns=["episode_id", "status", "length", "total_reward", "ts", "rewards", "values", "channels"])

        def close(self):
            pass

    return steps.groupBy("episode_id").transformWithStateInPandas(statefulProcessor=Recorder(), outputStructType=EPISODE, outputMode="Append", timeMode="None")


def write_episodes(episodes: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start writing finished episodes to a folder of Parquet files."""
    writer = episodes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def recorded_steps(episodes: DataFrame) -> DataFrame:
    """The steps of finished episodes as ``sources.dispatch`` takes them: signals by channel, reward and done by t."""
    done = episodes.where("status = 'done'")
    rows = done.select("episode_id", F.explode(F.arrays_zip("ts", "rewards", "values", "channels")).alias("s"), F.array_max("ts").alias("end"))
    signal = rows.select("episode_id", F.lit("signal").alias("lane"), F.col("s.channels").alias("channel"), F.col("s.ts").alias("t"), F.col("s.values").alias("value"))
    ticks = rows.groupBy("episode_id", F.col("s.ts").alias("t"), "end").agg(F.sum("s.rewards").alias("r"))
    more = F.array(F.struct(F.lit("reward").alias("k"), F.col("r").alias("v")), F.struct(F.lit("done").alias("k"), (F.col("t") == F.col("end")).cast("double").alias("v")))
    more = ticks.select("episode_id", "t", F.explode(more).alias("m")).select("episode_id", F.col("m.k").alias("lane"), F.col("m.k").alias("channel"), "t", F.array("m.v").alias("value"))
    return signal.unionByName(more)


def write_containers(episodes: DataFrame, path: str, checkpoint: str, available_now: bool = True, codec: str = "zstd"):
    """Start writing finished episodes to a mounted folder, a container file for each.

    Header and index are part of the one write, and a file is renamed to its name
    when it is whole. A batch that runs again after a failure writes the same files
    again. Episodes that aren't done are left out.
    """
    from ..sources import dispatch

    def sink(batch: DataFrame, number: int) -> None:
        dispatch.save(recorded_steps(batch), path, codec=codec)

    writer = episodes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_rewards(steps: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rewards by time window, behind a watermark; later rows are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return steps.withWatermark("ts", late).groupBy(w.alias("w"), "channel").agg(F.count("*").alias("n"), F.sum("reward").alias("total_reward"))


def session_rewards(steps: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Rewards of an episode's bursts: steps no further apart than ``gap``."""
    return steps.withWatermark("ts", late).groupBy("episode_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("reward").alias("total_reward"))
