"""Runs of streams that end: all that has arrived is processed, over one checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for ``name`` in the folder that ``spark.checkpoint.dir`` gives; only a local
    master may do without the setting, and then has a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault(app, _own.get(app) or tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(
    stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append"
) -> None:
    """Process all that ``stream`` has to give, into ``folder/out`` or by ``each`` batch.

    The checkpoint is in ``folder``, so a later call goes on where this one ended, and a
    call that fails can be made again.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(f"{folder}/out")
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What ``stream`` has put out so far, after :func:`drain`."""
    drain(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, read back: for what is read more than once."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
