"""Tables between the rounds of an iterative job, in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset (one machine) a folder of our own."""
    global _own
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="velonet-")
    return _own


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def open_file(path: str):
    """A file to seek in: a local path, or a file:, hdfs: or s3: address."""
    store, inner = _store(path)
    return store.open_input_file(inner)


def list_files(path: str, endings: tuple[str, ...]) -> list[str]:
    """A file itself, or the files of a folder with one of the endings, by name."""
    from pyarrow import fs

    store, inner = _store(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name.lower().endswith(endings))
    return [f"{path.rstrip('/')}/{n}" for n in names]


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and read back: the plan starts anew, and any executor may be lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The table of an iterative job: each write drops the one before, which nothing reads any more."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def write(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = f"{shared_folder(spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if before:
            where = spark._jvm.org.apache.hadoop.fs.Path(before)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        return spark.read.schema(df.schema).parquet(self.path)


class Parts:
    """What an iterative job knows so far: each round appends a table, and only every few rounds all are merged into one.

    ``merge`` makes one row of what several rounds say of a key.
    """

    def __init__(self, name: str, merge: Callable[[DataFrame], DataFrame], every: int = 12):
        self.name, self.merge, self.every = name, merge, every
        self.parts: list[tuple[str, DataFrame]] = []

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        path = f"{shared_folder(df.sparkSession)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path, df.sparkSession.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as the newest part; it stays readable for the next round whatever is merged."""
        if len(self.parts) >= self.every:
            spark, old = df.sparkSession, self.parts
            new = self._write(df)  # reads the old parts
            self.parts = [self._write(self.merge(self.table())), new]
            for path, _ in old:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        else:
            self.parts.append(self._write(df))
        return self.parts[-1][1]

    def table(self) -> DataFrame:
        """All parts; a key may have a row in several."""
        out = self.parts[0][1]
        for _, part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    def merged(self) -> DataFrame:
        return self.merge(self.table())


def on_worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever the working directory.

    On a cluster the package is installed or shipped; a path that an executor doesn't have is ignored there.
    """
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in parts:
        env["PYTHONPATH"] = os.pathsep.join([here, *parts])
