"""Helpers that the corpus operators share: shared storage, row identity, token splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where the master is local may the setting be missing: a new temporary folder
    is then made once for the application and used as its checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when the job ends, not at some later collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: after the loss of an executor the rows are read again,
    not computed again, so values that depend on the first computation stay fixed.
    The job's shuffle files are not needed any more and are dropped.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _dropping_shuffles(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the tables that :func:`materialize` wrote and that these read.

    Only for what no result reads any more; files outside the shared folder are left alone.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        shared = context._jvm.org.apache.hadoop.fs.Path(shared_dir(table.sparkSession)).toUri().getPath()
        path = context._jvm.org.apache.hadoop.fs.Path
        for name in {file.rpartition("/")[0] for file in table.inputFiles()}:
            folder = path(name)
            if folder.getParent().toUri().getPath() == shared:
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def quoted(name: str) -> Column:
    """Column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
