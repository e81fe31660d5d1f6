"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COUNT = itertools.count()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints and written tables.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, a temporary folder is made and set as the
    checkpoint directory; on a cluster that would be another disk on each machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="episodeflow-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{next(_COUNT)}-{uuid.uuid4().hex[:12]}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of what is written meanwhile are deleted once it is written, as nothing else reads them."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files survive lost executors, and each later use reads them instead of
    computing ``df`` again.
    """
    return materialise_parts([df], label)


def materialise_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """One written table of frames of one schema; the shuffle files of each are freed before the next is made."""
    path = None
    for df in parts:
        path = path or scratch_path(df.sparkSession, label)
        with freed_shuffles(df.sparkSession):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing still to be computed reads."""
    for df in written:
        delete_path(df.sparkSession, df.scratch_path)


BROADCAST_ROWS = 1_000_000


def small_side(written: DataFrame) -> DataFrame:
    """A written table of few narrow columns as the small side of a join.

    It is broadcast if its counted rows are at most ``BROADCAST_ROWS``, a few tens
    of MB; a larger one is hashed within each partition of a shuffle.
    """
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written.hint("shuffle_hash")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A written copy of ``df`` with a number that is unique for each row, repeated rows included.

    The number depends on how rows are dealt to partitions, and a scan deals them
    anew where the executors' number has changed meanwhile. So it is written with
    the rows, once, and all uses read the same.
    """
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def stage_input(docs: DataFrame) -> DataFrame:
    """doc_id and text of a stage's documents; all other columns in one, so that none clashes with an operator's."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("_others")] if others else []))


def stage_output(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` of rows made from ``stage_input(docs)``."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_others")[c].alias(c) for c in docs.columns])


SLICE_BYTES = 4_000_000


def slices(batches):
    """Arrow batches cut into pieces of about ``SLICE_BYTES``, of one row at least.

    Python's objects take several times the bytes of the rows they are made of.
    """
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def add_columns(df: DataFrame, inputs: list[str], outputs: list[tuple[str, str]], make, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns computed by Python over Arrow batches.

    ``make()`` runs once in each task and returns a function that takes one list
    for each of ``inputs`` (strings come as UTF-8 ``bytes``, nulls as ``None``)
    and returns one array or list for each of ``outputs`` (name, Spark type).
    The other columns of ``df`` pass through untouched, but for those in
    ``drop``. A column of ``df`` with the name of an output is replaced by it.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    made = [n for n, _ in outputs]
    out = T.StructType([f for f in df.schema.fields if f.name not in made and f.name not in drop])
    kept = [f.name for f in out.fields]
    if len(set(kept)) < len(kept):
        raise ValueError("the frame has several columns of one name")
    types = []
    for name, kind in outputs:
        kind = T._parse_datatype_string(kind)
        types.append(to_arrow_type(kind))
        out.add(name, kind)

    def run(batches):
        apply = make()
        for batch in slices(batches):
            columns = []
            for name in inputs:
                column = batch.column(name)
                if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                    column = column.cast(pa.large_binary())
                columns.append(column.to_pylist())
            values = apply(*columns)
            arrays = [batch.column(n) for n in kept] + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + made)

    return df.mapInArrow(run, out)
