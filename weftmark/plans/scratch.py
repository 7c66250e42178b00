"""Intermediate tables: written to the folder all executors share, read back without lineage.

A written table survives the loss of any executor and cuts the plan of an iterative job. The folder
is ``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder is used on a
local master, where all tasks share one machine; on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder for intermediate tables, under ``spark.checkpoint.dir`` where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base:
        return f"{base.rstrip('/')}/weftmark-{app}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="weftmark-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return a DataFrame over the written files.

    With ``partition_by`` each value of those columns gets a folder of its own, so that a filter on them reads no other.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class BucketedTable:
    """A bucketed table in the shared folder; reading it by its key needs no shuffle."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path

    @classmethod
    def write(cls, df: DataFrame, name: str, keys: list[str], buckets: int) -> BucketedTable:
        spark = df.sparkSession
        table, path = f"{name}_{uuid.uuid4().hex}", new_path(spark, name)
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
        return cls(spark, table, path)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the table out of the catalog; its files stay readable by path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        self.forget()
        delete_path(self.spark, self.path)


def _value_bytes(field: T.StructField) -> Column:
    """About how many bytes a value takes in memory."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(16)


def fits_broadcast(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> bool:
    """Whether a side has at most ``most_rows`` rows and ``most_bytes`` bytes.

    The measurement stops after ``most_rows`` rows, so a large side is refused cheaply. ``df`` should be
    a written table or a plain scan, since it is read once more for it.
    """
    size = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0)).cast("bigint")
    rows, total = df.limit(most_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= most_rows and total <= most_bytes


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 32 << 20) -> DataFrame:
    """The side, computed and written once, with a broadcast hint if it is small enough; else it is left to a shuffle join."""
    side = materialize(df, "side")
    return F.broadcast(side) if fits_broadcast(side, most_rows, most_bytes) else side


def drop_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that were not written are lost with them."""
    delete_path(spark, scratch_dir(spark))
