"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)
_NAME = re.compile(r"-[0-9a-f]{32}$")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cloakframe-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, to be cleared with the rest."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    if (own := _scope.get()) is not None:
        own.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths made inside, by this thread of control; drop() them once what reads them is stored."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(spark: SparkSession, paths: Iterable[str]) -> int:
    """Delete these tables."""
    paths = list(paths)
    for path in paths:
        files, at = _files(spark, path)
        files.delete(at, True)
    gone = set(paths)
    _made[:] = [p for p in _made if p not in gone]
    return len(paths)


def clear(spark: SparkSession) -> int:
    """Delete the tables written so far; call it once the results that read them are stored."""
    return drop(spark, list(_made))


def clear_old(spark: SparkSession, hours: float) -> int:
    """Delete tables of this kind in the shared folder that no run has touched for so long."""
    files, at = _files(spark, shared_dir(spark))
    limit = (time.time() - 3600 * hours) * 1000
    old = [s.getPath().toString() for s in files.listStatus(at) if _NAME.search(s.getPath().getName()) and s.getModificationTime() < limit]
    return drop(spark, old)
