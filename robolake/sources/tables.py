"""Input tables, and readings, trials, faults, costs and edges derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from robolake.functions.columns import micros
from robolake.functions.slices import HOT, SLICE, carried, real, sliced

#: What splits events into a baseline and a candidate version.
CANDIDATE_FROM = "2024-01-16"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_rows(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    """Rows of JSON or CSV files by an explicit schema; rows that don't fit it have nulls there."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("channel"), micros("ts").alias("us"), "value",
        F.col("event_id").alias("id")
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version, cell, repeat, success and latency of each run; runs from CANDIDATE_FROM on are the candidate's."""
    e = load(spark, sf_dir, "events")
    version = F.when(F.col("ts") < F.lit(CANDIDATE_FROM).cast("timestamp_ntz"), "base").otherwise("cand")
    return e.select(
        version.alias("version"), F.col("event_type").alias("cell"), (F.col("user_id") % 3).alias("repeat"),
        (F.col("value") > 50).alias("success"), F.col("value").alias("latency"), micros("ts").alias("us"), F.col("user_id").alias("entity"),
        F.col("event_id").alias("id")
    )


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost lines: category, item, quantity, cost."""
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("category"), F.col("p_type").alias("kind"), F.col("l_partkey").alias("item"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("cost")
    )


def transitions(spark: SparkSession, sf_dir: str, hours: int = 0, hot: int = HOT) -> DataFrame:
    """Edges between the channels that follow each other for an entity, with how often; with ``hours``, between channels in parts of the day so many hours long."""
    rows = readings(spark, sf_dir)
    if hours:
        part = F.floor(F.col("us") / (hours * 3_600_000_000)) % (24 // hours)
        rows = rows.withColumn("channel", F.concat_ws(":", "channel", part.cast("string")))
    rows = carried(sliced(rows.select("entity", "channel", "us", "id"), ("entity",), "us", hot), ("entity",), ("us", "id"), 1)
    w = Window.partitionBy("entity", SLICE).orderBy("us", "id")
    r = real(rows.withColumn("src", F.lag("channel").over(w))).filter("src is not null")
    return r.groupBy("src", F.col("channel").alias("dst")).agg(F.count(F.lit(1)).alias("w"))
