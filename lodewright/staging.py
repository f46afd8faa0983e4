"""Tables written once and read again: they cut lineage in a way that outlives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    A local session without that setting (a test) gets a folder of its own; on a cluster it must be set.
    """
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        here = spark.sparkContext.getCheckpointDir()
        if not here:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodewright-"))
            here = spark.sparkContext.getCheckpointDir()
    return str(here).rstrip("/")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This also fixes what a range partitioning or a row number decided.
    """
    return _write(df, name)[0]


def spread(df: DataFrame, *by: str, rows: int, n: int | None = None) -> DataFrame:
    """``df`` dealt by its columns ``by`` into tasks of about ``rows`` rows each, whatever its files are like; a smaller one is left as it is.

    For steps whose memory follows from the rows of a task.  Rows (``n``) are counted if they are not given: read from staged tables, this is cheap.
    """
    n = df.count() if n is None else n
    return df if n <= rows else df.repartition(max(-(-n // rows), df.sparkSession.sparkContext.defaultParallelism), *by)


class Scratch:
    """Staged tables that nothing reads once the block that opened this is left; they are deleted then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _write(df, name)
        self.paths.append(path)
        return table

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
