"""Session settings, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What a session needs for results to be the same everywhere.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quotemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; conf wins over them. master None leaves the cluster's choice."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | conf)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder, else one of our own on a single machine.

    Raises ValueError on a cluster that names none: a machine's own folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quotemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


_left: dict[str, SparkSession] = {}


class Stored:
    """A DataFrame written to the shared folder; drop() removes its files once nothing reads them any more, what is left goes when Python ends.

    Reading it again costs a scan of what it holds, not the work that made it, on whichever executors are left.
    """

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession
        self.path = os.path.join(shared_folder(self.spark), f"stored-{uuid.uuid4().hex}")
        _left[self.path] = self.spark
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _left.pop(self.path, None)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[None]:
    """What Stored writes inside goes at the end; a result that reads it must be written or collected before."""
    before = set(_left)
    try:
        yield
    finally:
        for path in set(_left) - before:
            stored = Stored.__new__(Stored)
            stored.spark, stored.path = _left[path], path
            stored.drop()


@atexit.register
def _clear() -> None:
    for path, spark in list(_left.items()):
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/"), ignore_errors=True)
        else:
            try:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # noqa: BLE001, S110 - the session may be gone
                pass
