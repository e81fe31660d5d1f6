"""Replay episodes in NumPy archives: loading, and saving with derived flags."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession

#: Keys that are no observations, keys of actions, and keys that are observations of any rank.
RESERVED = ("action", "act", "act_disc", "act_cont", "reward", "is_first", "is_last", "is_terminal", "stepid", "discount", "done")
ACTIONS = ("action", "act", "act_disc", "act_cont")
OBSERVATIONS = ("image", "vector", "state", "proprio", "obs")
STEPS = "file string, episode_id string, t bigint, channel string, lane string, value array<double>, is_last boolean, is_terminal boolean, is_first boolean, truncated boolean"


def episode_id_of(path: str) -> str:
    """The second part of a file name of four or more parts, else all of it."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    parts = stem.split("-")
    return parts[1] if len(parts) >= 4 else stem


def _arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; needs the driver's session."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """The steps of replay archives; truncated is what ends without being terminal.

    A flag array that is shorter than its episode says nothing of the steps beyond
    it. Pickled arrays are refused.
    """
    return parse_npz(spark.read.format("binaryFile").load(path))


def parse_npz(files: DataFrame) -> DataFrame:
    """The steps of replay archives (path, content)."""

    schema = _arrow_schema(STEPS)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path_, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as data:
                    arrays = {k: data[k] for k in data.files if data[k].ndim and len(data[k])}
                n = max((len(a) for a in arrays.values()), default=0)
                flag = lambda *keys, a=arrays, n=n: next((np.pad(a[k].astype(bool).ravel()[:n], (0, max(0, n - a[k].size))) for k in keys if k in a), np.zeros(n, bool))
                terminal = flag("is_terminal", "is_last")
                observed = [k for k, a in arrays.items() if k in OBSERVATIONS or a.ndim >= 2 and k not in RESERVED]
                lanes = [(k, "signal") for k in observed] + [(k, "action") for k in ACTIONS if k in arrays] + [("reward", "reward")] * ("reward" in arrays)
                for name, lane in lanes:
                    a = arrays[name].reshape(len(arrays[name]), -1).astype("f8")
                    m = len(a)
                    columns = [[path_] * m, [episode_id_of(path_)] * m, range(m), [name] * m, [lane] * m, list(a), flag("is_last")[:m], terminal[:m], flag("is_first")[:m], (flag("is_last") & ~terminal)[:m]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    return files.select("path", "content").mapInArrow(run, STEPS)


def npz_bytes(arrays: dict) -> bytes:
    import numpy as np

    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def pack_npz(steps: DataFrame, arrays: dict[str, str], by: str = "episode_id", order: str = "t") -> DataFrame:
    """(path, content): a replay archive for each episode, with its flags.

    ``steps`` has terminated and truncated; is_first, is_last and is_terminal are
    derived. ``arrays`` maps keys to columns.
    """
    from pyspark.sql import functions as F

    from ..operators.episodes import boundary_flags

    flagged = boundary_flags(steps, by=by, order=order).withColumn("is_terminal", F.col("terminated"))
    keys = {**arrays, "is_first": "is_first", "is_last": "is_last", "is_terminal": "is_terminal"}
    rows = flagged.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, *sorted(set(keys.values()))))).alias("s"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [[], []]
            for r in batch.to_pylist():
                out[0].append(f"{r['id']}.npz")
                out[1].append(npz_bytes({k: np.array([s[c] for s in r["s"]]) for k, c in keys.items()}))
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.binary())], names=["path", "content"])

    return rows.select(F.col(by).cast("string").alias("id"), "s").mapInArrow(run, "path string, content binary")
