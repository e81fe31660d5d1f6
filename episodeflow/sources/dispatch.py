"""Loading, saving and converting episodes by format.

Steps have one form whatever they come from: (episode_id, lane, channel, t, value),
``value`` an array of doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import container, npz
from .files import write_files

STEPS = ("episode_id", "lane", "channel", "t", "value")
FORMATS = ("container", "npz", "parquet")
#: Formats that are known and can't be read or written here.
UNSUPPORTED = ("hdf5", "tdmpc2", "minari", "d4rl")


def _checked(name: str) -> str:
    if name in UNSUPPORTED:
        raise NotImplementedError(f"the format {name} is not supported")
    if name not in FORMATS:
        raise ValueError(f"unknown format {name}")
    return name


def format_of_path(spark: SparkSession, path: str) -> str:
    """The one format of the files of a path, by their names, else by their first bytes."""
    from ..functions.names import format_of

    files = spark.read.format("binaryFile").load(path)
    by_name = [r[0] for r in files.select(format_of(F.col("path"), F.lit(b"")).alias("f")).distinct().limit(9).collect()]
    if by_name == ["unknown"]:  # only then are first bytes looked at
        by_name = [r[0] for r in files.select(format_of(F.lit(""), F.substring("content", 1, 4)).alias("f")).distinct().limit(9).collect()]
    if len(by_name) != 1:
        raise ValueError(f"{path} has files of {len(by_name)} formats")
    return by_name[0]


def load(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """The steps of the episodes of a path or glob; without a stated format, that of its files."""
    format = _checked(format or format_of_path(spark, path))
    if format == "parquet":
        return spark.read.parquet(path).select(*STEPS)
    if format == "npz":
        return npz.read_npz(spark, path).select(*STEPS)
    steps = container.decode_steps(container.read_blocks(spark, path))
    # a block without a channel is named by its lane
    return steps.select(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1).alias("episode_id"), "lane", F.when(F.col("channel") == "", F.col("lane")).otherwise(F.col("channel")).alias("channel"), "t", "value")


def save(steps: DataFrame, path: str, format: str = "container", codec: str = "zstd", dtype: str = "f64") -> None:
    """Write steps to a new folder: a file for each episode, or Parquet.

    Values keep ``dtype``. A channel's steps go to files in order of t, and t itself
    isn't kept in files: read again, it counts from 0 on.
    """
    _checked(format)
    steps = steps.select(*STEPS)
    if format == "parquet":
        steps.write.parquet(path)
        return
    # sorted within each channel first: a task holds one channel, then one episode
    channels = steps.groupBy("episode_id", "lane", "channel").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s"))
    channels = channels.select("episode_id", "lane", "channel", F.coalesce(F.size(F.get("s", F.lit(0))["value"]), F.lit(1)).alias("width"), F.flatten(F.transform("s", lambda x: x["value"])).alias("flat"))
    episodes = channels.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("lane", "channel", "width", "flat"))).alias("c"))

    def files(batches):
        import json

        import numpy as np
        import pyarrow as pa

        from ..functions.binary import encode_tensor

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if format == "npz":
                    name, content = f"{row['episode_id']}.npz", npz.npz_bytes({c["channel"]: np.array(c["flat"]).reshape(-1, c["width"]) if c["width"] != 1 or c["lane"] == "signal" else np.array(c["flat"]) for c in row["c"]})
                else:
                    blocks, listed, longest = {}, [], 0
                    for c in row["c"]:
                        block = c["lane"] if c["lane"] in ("reward", "done") else f"{c['lane']}/{c['channel']}"
                        blocks[block] = encode_tensor(c["flat"], dtype)
                        listed.append({"id": c["channel"], "dtype": dtype, "shape": [c["width"]], "signal_block": block})
                        longest = max(longest, len(c["flat"]) // max(1, c["width"]))
                    blocks["meta/channels"] = json.dumps({"channels": listed}).encode()
                    blocks["meta/episode"] = json.dumps({"episode_id": row["episode_id"], "length_T": longest}).encode()
                    blocks["time/ticks"] = encode_tensor(range(longest), "i32")
                    name, content = f"{row['episode_id']}.bin", container.write_container(blocks, codec)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

    write_files(episodes.select(F.col("episode_id").cast("string").alias("episode_id"), "c").mapInArrow(files, "path string, content binary"), path)


def convert(spark: SparkSession, source: str, target: str, to: str, format: str | None = None) -> None:
    """Load the episodes of ``source`` and save them to the new folder ``target``."""
    _checked(to)
    save(load(spark, source, format), target, to)
