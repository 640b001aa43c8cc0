"""Sessions and settled tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; on a cluster master and sizes come from its own settings."""
    b = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_written: list[str] = []
#: Since Spark 4.1; without it shuffle files stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidying = threading.Lock()


@atexit.register
def _drop_local() -> None:
    """Folders that this process wrote to a local disk go with it."""
    for path in _written:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def settled() -> int:
    """How many tables settle() has written in this process and drop_settled() has not deleted."""
    return len(_written)


def drop_settled(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes all that settle() wrote in this process, or what it wrote between two answers of settled(), wherever it lies; no result that is still to be read may rest on it."""
    gone = _written[since:until]
    del _written[since:until]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, tidy: bool = False) -> DataFrame:
    """df written to the folder that all executors share (spark.checkpoint.dir) and read again.

    Loops settle each step: the plan stays as long as one step, and a lost executor takes nothing along. With tidy, what
    was shuffled for it is deleted once it is written; the session's setting for that is put back.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodegraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    _written.append(path)
    if tidy:
        with _tidying:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
            try:
                df.write.parquet(path)
            finally:
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
