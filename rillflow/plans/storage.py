"""Intermediate tables in the folder all executors share.

Lineage is cut with written Parquet tables, never with localCheckpoint: a lost executor then costs a re-read and not
a recomputation, and the written row order and partition numbers stay fixed for every later job.

All tables of a run lie in one folder of their own. ``workspace`` removes what was written inside it when it ends; what
is left is removed when the Python program that made the session ends, or by ``release``.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Folders and catalog tables written and not removed yet, oldest first.
_written: list[tuple[str, str]] = []
_RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master where it is unset."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="rillflow-")
    spark.conf.set(_SETTING, named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a new table, which is removed with the run."""
    path = f"{shared_dir(spark)}/rillflow-{_RUN}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_at_exit)
    _written.append(("path", path))
    return path


def new_table(label: str) -> str:
    """A name for a new catalog table, which is dropped with the run."""
    name = f"rf_{label}_{uuid.uuid4().hex}"
    _written.append(("table", name))
    return name


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once and return a reader of the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables written by this program (after the first ``since``). DataFrames made of them can't be read any more."""
    while len(_written) > since:
        kind, name = _written.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            delete(spark, name)
    if not since and spark.conf.get(_SETTING, None):
        delete(spark, f"{shared_dir(spark)}/rillflow-{_RUN}")


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Remove at its end all tables written inside it: use up results inside."""
    before = len(_written)
    try:
        yield
    finally:
        release(spark, before)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context is not None else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark)
    for kind, name in _written:
        if kind == "path" and name.startswith(("file:/", "/")):
            shutil.rmtree(name.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def shuffle_width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
