"""Files read by place, files written whole, and scratch folders."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Memory:
    """Bytes behind the interface of an opened file: its size, and reads by place."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    @classmethod
    def of(cls, data):
        return cls(bytes(data)) if isinstance(data, bytes | bytearray | memoryview) else data

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class Opened:
    """An opened file that is read by place."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)


def _local(path: str) -> str | None:
    """The path on a disk or mount of this machine, or None for another store."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme != "file":
        return None
    from urllib.parse import unquote

    return unquote("/" + rest.lstrip("/"))


@contextmanager
def opened(path: str, size: int):
    """A file of a mounted folder, or of a store that Arrow reads, for reads by place."""
    local = _local(path)
    if local is not None:
        with open(local, "rb", buffering=0) as f:
            yield Opened(f, size)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        yield Opened(f, size)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; in local mode without it a temporary one."""
    import os
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "episodeflow")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_files(files: DataFrame, path: str) -> None:
    """Write (path, content) rows as files of a mounted folder that all executors can write.

    Each file is written under a task's own name and then renamed, so a repeated
    or lost task leaves no part of a file under its name.
    """
    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    class Writer(DataSourceWriter):
        def __init__(self, folder: str):
            self.folder = folder

        def write(self, rows):
            import os
            import uuid

            for row in rows:
                target = os.path.join(self.folder, row["path"])
                part = f"{target}.{uuid.uuid4().hex}.partial"
                with open(part, "wb") as f:
                    f.write(row["content"])
                os.replace(part, target)
            return WriterCommitMessage()

        def abort(self, messages):
            import contextlib
            import glob
            import os

            for part in glob.glob(os.path.join(self.folder, "*.partial")):
                with contextlib.suppress(OSError):
                    os.remove(part)

    class Containers(DataSource):
        @classmethod
        def name(cls):
            return "episode_container"

        def writer(self, schema, overwrite):
            return Writer(self.options["path"])

    path = _local(path)
    if path is None:
        raise ValueError("files are written to mounted folders only")
    import os

    os.makedirs(path, exist_ok=True)
    files.sparkSession.dataSource.register(Containers)
    files.select("path", "content").write.format("episode_container").mode("append").save(path)


