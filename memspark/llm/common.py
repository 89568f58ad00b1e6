"""What the operators share: reading, written intermediate tables, and texts as byte arrays."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a local
    session gets a folder of its own; on a cluster it is an error, as no other folder is shared."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, is computed once, and
    outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def distinct_rows(docs: DataFrame) -> DataFrame:
    """docs with each row once.  Only rows whose 128-bit hash occurs again are shuffled, so texts that
    stand once stay where they are; copies of a row meet in partial aggregates."""
    plain = [F.col(f"`{c}`").cast("string") if kind.startswith(("map", "variant")) else F.col(f"`{c}`") for c, kind in docs.dtypes]
    # null and empty differ
    own = F.struct(F.xxhash64(*plain, *(c.isNull() for c in plain)), F.xxhash64(F.lit(7), *plain))
    marked = docs.withColumn("_row_hash", own)
    again = marked.groupBy(F.col("_row_hash").alias("_again")).count().where("count > 1").select("_again")
    marked = marked.join(again, F.col("_row_hash") == F.col("_again"), "left")
    copies = marked.where(F.col("_again").isNotNull()).dropDuplicates(["_row_hash"])
    return marked.where(F.col("_again").isNull()).unionByName(copies).select(*(F.col(f"`{c}`") for c in docs.columns))


def give_back() -> None:
    """Return the memory that a Python worker no longer uses: Spark keeps workers for later tasks, and
    what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A function for mapInArrow that gives memory back at the end of its task."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        give_back()

    return inner


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, unless the cluster sets a size of its own: workers and Arrow's
    buffers then need little memory, however long the texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(name, None) is None:
        spark.conf.set(name, "8m")


def texts_of(column, most: int = 64):
    """The values of an Arrow column one after the other, of which few are Python objects at once."""
    for at in range(0, len(column), most):
        yield from column.slice(at, most).to_pylist()


def flat_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): the UTF-8 of a string or binary Arrow column as one array without copying;
    text k is bytes[ends[k]:ends[k+1]].  Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def runs_by_size(ends: np.ndarray, most: int = 4_000_000):
    """(from, to) ranges of texts that hold about `most` bytes together, one text at least."""
    n, at = len(ends) - 1, 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to
