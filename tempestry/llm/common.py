"""What the training-data operators share: the cluster's shared folder, written tables and small expressions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: space and \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, the warehouse, which all executors reach as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts are held several times on both sides of a task, so they have few rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


#: Where new tables are put below the shared folder.
_BELOW: ContextVar[str] = ContextVar("below", default="tempestry")


@contextmanager
def below(folder: str) -> Iterator[None]:
    """New tables are put below that folder, so that they can be deleted together."""
    token = _BELOW.set(f"tempestry/{folder}")
    try:
        yield
    finally:
        _BELOW.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{_BELOW.get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, is computed once and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, below: str = "") -> None:
    """Deletes the tables and files that written() and new_path() have made, of all or of those below that folder; call
    it once results are stored elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tempestry/{below}".rstrip("/"))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
