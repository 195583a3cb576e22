"""Session settings the library reads, and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where that setting may be unset.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within is over when its shuffles are read, and their files need not wait for the driver to collect
    its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, True)
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the
    loss of executors, and lets later passes read only the columns they need. With ``by``, each value has a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cuespan-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.partitionBy(*by).parquet(path)
    spark.sparkContext.cuespan_written = [*getattr(spark.sparkContext, "cuespan_written", []), path]
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as programs open it that know no Hadoop; None where it is on another file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "cuespan_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="cuespan-")) / "cuespan.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context.cuespan_shipped = True


def written_paths(spark: SparkSession) -> list[str]:
    """Where ``written`` has put tables that are there still, the oldest first."""
    return list(getattr(spark.sparkContext, "cuespan_written", []))


def drop_written(spark: SparkSession, paths: Sequence[str] | None = None) -> None:
    """Delete ``paths``, or all that ``written`` has written in this application. Results that have not been read yet need it
    still."""
    context = spark.sparkContext
    paths = written_paths(spark) if paths is None else list(paths)
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    context.cuespan_written = [p for p in written_paths(spark) if p not in set(paths)]
