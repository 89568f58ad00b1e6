"""A kept table of state in buckets, of which a batch reads and writes those that its keys fall into.

Layout: path/bucket=b/batch=n.  The last folder of a bucket is its state; batch n reads the folders
before n and replaces path/bucket=b/batch=n alone, so a batch that is run again after a failure
starts from the same rows.  Folders that a later batch has replaced are deleted one batch afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucket_of(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, path: str, buckets: list[int] | None = None) -> dict[int, list[int]]:
    """bucket -> its batches, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(folder: str, name: str) -> list[int]:
        where = hadoop(folder)
        found = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(f.partition("=")[2]) for f in found if f.startswith(f"{name}="))

    return {b: numbers(f"{path}/bucket={b}", "batch") for b in (numbers(path, "bucket") if buckets is None else buckets)}


def current(spark: SparkSession, path: str, schema, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The state (of the given buckets, before batch `below`); empty if nothing is kept."""
    found = {b: [n for n in batches if below is None or n < below] for b, batches in _folders(spark, path, buckets).items()}
    paths = [f"{path}/bucket={b}/batch={batches[-1]}" for b, batches in found.items() if batches]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def touched(writes: DataFrame, columns: list[str], buckets: int) -> list[int]:
    """The buckets of a batch, `buckets` at most."""
    return sorted(r.b for r in writes.select(bucket_of(columns, buckets).alias("b")).distinct().collect())


def replace(state: DataFrame, path: str, columns: list[str], buckets: int, batch: int) -> None:
    """Write a batch's buckets; other buckets' files aren't touched.  Whatever the batches before the
    last one left in these buckets goes."""
    spark = state.sparkSession
    rows = state.withColumns({"bucket": bucket_of(columns, buckets), "batch": F.lit(batch)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for b, batches in _folders(spark, path).items():
        for old in [n for n in batches if n < batch][:-1]:
            fs.delete(hadoop(f"{path}/bucket={b}/batch={old}"), True)
