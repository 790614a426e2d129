"""Written intermediate tables: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests, local runs) a temporary folder of this process is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    own = tempfile.mkdtemp(prefix="pathquant-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return shared_root(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables stored in the run that is open in this thread, or outside of any.
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)
_outside: list[str] = []


def remove_stored(spark: SparkSession, names: list[str] | None = None) -> None:
    """Deletes the tables that were stored outside of a run, or those named. Call it once results are written."""
    names = _outside if names is None else names
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while names:
        path = jvm.org.apache.hadoop.fs.Path(names.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def stored_run(spark: SparkSession):
    """What is stored in the block, by this thread, is deleted at its end: write the results in it. Runs in other threads keep theirs."""
    names: list[str] = []
    token = _run.set(names)
    try:
        yield
    finally:
        _run.reset(token)
        remove_stored(spark, names)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder and returns the written table: cuts lineage, survives lost executors. options: of the writer."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    own = _run.get()
    (_outside if own is None else own).append(path)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
