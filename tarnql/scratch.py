"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that this process has made and not yet removed.
_made: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, on one machine only: on a cluster every machine would have its own, so
    there it is an error. The temporary folder is removed when Python ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> int:
    """Removes every table that this process has written to the shared folder, and says how many folders there were.

    Call it when the results of earlier operators have been written or read: a DataFrame that an operator returned reads
    such tables, and fails after this.
    """
    n = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return n


@atexit.register
def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clean(spark)
    for path in _made:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


#: While it is set, Spark drops the shuffle files of a query when the query ends, instead of some time later.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written once to a shared folder, which cuts lineage: a lost executor costs a re-read, not a re-run.

    They stay until ``drop``, ``clean`` or the end of the process that made them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, shared_folder(spark, name)
        _made.append(self.path)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes and reads again, in a folder for each value of ``by`` if that is given. No shuffle file outlives the write."""
        schema, conf = df.schema, self.spark.conf
        writer = df.write.mode("overwrite")
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
