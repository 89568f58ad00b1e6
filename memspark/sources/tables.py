"""Scans, appends and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table; a given schema saves reading footers for inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of a table in a given order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def conform(df: DataFrame, schema: StructType, **defaults) -> DataFrame:
    """Rows in a table's schema; missing columns and nulls get their default."""
    made = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        made.append(value.cast(field.dataType).alias(field.name))
    return df.select(*made)


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Add rows to an append-only table."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def complete_runs(runs: DataFrame, completions: DataFrame) -> DataFrame:
    """Runs with the end and status of their completion, if any."""
    done = completions.groupBy("run_id").agg(F.max_by("status", "ended_at").alias("_s"), F.max("ended_at").alias("_e"))
    joined = runs.join(done, "run_id", "left")
    return joined.withColumns({"status": F.coalesce("_s", "status"), "ended_at": F.coalesce("_e", "ended_at")}).drop("_s", "_e")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table that a job writes and reads again, in spark.checkpoint.dir."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed to the folder all executors share: cuts the lineage of an iteration."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="memspark-"))
    return df.checkpoint()
