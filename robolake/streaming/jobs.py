"""Streaming operators. Sources have a TIMESTAMP column ``ts``: watermarks need one, so a zoneless one is cast."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from robolake.functions.columns import micros

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files, one a micro-batch. The pattern serves for one file as for a folder; a stream takes no plain path to one file."""
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1)
    return read.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def span_of(rows: DataFrame, n: int) -> Column:
    """Which of n equal spans of time, from 0 on, a row of events lies in."""
    lo, hi = rows.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    return F.expr(f"(unix_micros(cast(ts as timestamp)) - {lo or 0}) * {n} div {(hi or 0) - (lo or 0) + 1}").cast("int")


def in_files(rows: DataFrame, folder: str, n: int, number: Column | None = None) -> None:
    """Rows of events as n files, written one after the other, as a stream then takes them: by span of time, or by the number of its file."""
    numbered = rows.withColumn("__file", span_of(rows, n) if number is None else number)
    for k in range(n):
        numbered.filter(F.col("__file") == k).drop("__file").coalesce(1).write.mode("append").parquet(folder)


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as a stream, one file a micro-batch."""
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, late: str, width: str) -> DataFrame:
    counts = df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sliding(df: DataFrame, late: str, width: str, step: str) -> DataFrame:
    counts = df.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "n")


def sessions(df: DataFrame, late: str, gap: str) -> DataFrame:
    """The session's start comes from the whole grouped column: grouping by a part of it wouldn't merge sessions."""
    counts = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def interval_join(left: DataFrame, right: DataFrame, late: str, within: str) -> DataFrame:
    """Pairs of one user whose right event comes at most ``within`` after the left one; both sides drop state by watermark."""
    a = left.select("user_id", F.col("ts").alias("a_ts"), F.col("event_id").alias("a_id")).withWatermark("a_ts", late).alias("a")
    b = right.select("user_id", F.col("ts").alias("b_ts"), F.col("event_id").alias("b_id")).withWatermark("b_ts", late).alias("b")
    return a.join(b, F.expr(f"a.user_id = b.user_id AND b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {within}")).select("a.user_id", "a_id", "b_id")


def once(df: DataFrame, late: str, keys: tuple[str, ...]) -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


STATE = "user_id long, event_id long, state string"


def degrade(df: DataFrame, warn: int, stop: int) -> DataFrame:
    """State of a user after each event by its errors in a row; rows of a micro-batch are put in order, batches are taken as they come.

    A user's rows of one micro-batch stand in memory together; maxFilesPerTrigger bounds them.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"])
        place = np.arange(1, len(rows) + 1)
        last = np.maximum.accumulate(np.where(rows["event_type"].to_numpy() == "error", 0, place))
        run = np.where(last > 0, place - last, place + n)
        state.update((int(run[-1]),))
        told = np.where(run >= stop, "STOPPED", np.where(run >= warn, "DEGRADED", "NORMAL"))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "state": told})

    return df.groupBy("user_id").applyInPandasWithState(step, STATE, "n int", "append", "NoTimeout")


RECOVERY = "user_id long, us long, event_id long, state string"


class Recovery(StatefulProcessor):
    """degrade() with recovery: after a silence the user is RECOVERED, and errors in a row begin anew.

    State is the number of errors in a row and the time of the last row, carried between batches; it goes with the timer of event time that tells of the
    silence. A row that comes after the silence, but before the watermark has reached its end, tells of it itself. So what is told depends on the rows
    and the last watermark only, not on how rows are dealt into batches, as long as each batch is later than those before it for its users.
    """

    def __init__(self, warn: int, stop: int, silence: int):
        self.warn, self.stop, self.silence = warn, stop, silence  # silence in microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "n int, us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        got = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"])
        out = []
        for us, number, bad in zip(got["us"].tolist(), got["event_id"].tolist(), (got["event_type"] == "error").tolist(), strict=True):
            if last is not None and us - last > self.silence:
                out.append((last + self.silence, None, "RECOVERED"))
                n = 0
            n, last = n + 1 if bad else 0, us
            out.append((us, number, "STOPPED" if n >= self.stop else "DEGRADED" if n >= self.warn else "NORMAL"))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.silence) // 1000 + 1)
        self.state.update((n, last))
        yield self.told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            _, last = self.state.get()
            self.state.clear()
            yield self.told(key, [(last + self.silence, None, "RECOVERED")])

    def told(self, key, rows: list[tuple]) -> pd.DataFrame:
        us, number, state = zip(*rows, strict=True)
        return pd.DataFrame({"user_id": key[0], "us": us, "event_id": pd.array(number, "Int64"), "state": state})


def recovery(df: DataFrame, late: str, warn: int, stop: int, silence: int) -> DataFrame:
    """State of a user after each event, and when it has recovered from a silence (RECOVERY). Needs the RocksDB state store: see with_rocksdb().

    The rows of a user in one micro-batch stand in memory together: from_files() and events() take one file a batch.
    """
    rows = df.withWatermark("ts", late).withColumn("us", micros("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(Recovery(warn, stop, silence), RECOVERY, "append", "eventTime")


class with_rocksdb:
    """A block in which streams start with the RocksDB state store, which timers and typed state need."""

    NAME, CLASS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.NAME)
        self.spark.conf.set(self.NAME, self.CLASS)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.NAME, self.before)


def health(df: DataFrame, late: str, hours: int, n: int, margin: float) -> DataFrame:
    """Error rate of each bucket of so many hours that has events, its mean over those of the n buckets of time before, and an alert if it is above
    that by more than margin: two stateful operators, a window over the first one's windows, in append mode. A bucket is told once the watermark has passed its end."""
    bad = F.count_if(F.col("event_type") == "error").alias("bad")
    first = df.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours")).agg(F.count(F.lit(1)).alias("n"), bad)
    buckets = first.select(F.window_time("window").alias("at"), F.col("window.start").alias("start"), "n", (F.col("bad") / F.col("n")).alias("rate"))
    over = F.window("at", f"{hours * (n + 1)} hours", f"{hours} hours")
    near = buckets.select(over.alias("w"), "start", "n", "rate").withColumn("own", F.col("start") == F.col("w.end") - F.expr(f"interval {hours} hours"))
    of = lambda own, c: F.when(F.col("own") == own, F.col(c))
    told = near.groupBy("w").agg(F.sum(of(True, "n")).alias("n"), F.max(of(True, "rate")).alias("rate"), F.avg(of(False, "rate")).alias("baseline"))
    alert = F.coalesce(F.round(F.col("rate") - F.col("baseline") - margin, 9) > 0, F.lit(False)).alias("alert")
    bucket = (F.col("w.end") - F.expr(f"interval {hours} hours")).alias("bucket")
    return told.filter("n is not null").select(bucket, "n", "rate", "baseline", alert)


def progress_of(df: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, list[dict]]:
    """drain(), and the progress reports of its batches."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out), [json.loads(p.json) for p in q.recentProgress]


def dropped(reports: list) -> int:
    """Rows that stateful operators have dropped for coming after the watermark, by the progress reports. An aggregation counts what its partial sums have left of them."""
    return sum(op["numRowsDroppedByWatermark"] for p in reports for op in p["stateOperators"])


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a Parquet table, then give the table."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def ingest(source: DataFrame, good: str, rejected: str, checkpoint: str, rule: str) -> None:
    """Pipeline step: each batch's rows that meet the rule go to one table, the others to quarantine; rerunning takes unseen files only."""

    def split(batch: DataFrame, number: int) -> None:
        kept = F.coalesce(F.expr(rule), F.lit(False))
        batch.filter(kept).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(~kept).write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    q = source.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingested(spark: SparkSession, good: str, rejected: str, by: str) -> DataFrame:
    """Rows that ingest() has read, kept and put into quarantine so far, and from how many batches, by a column."""
    one = lambda path, kept: spark.read.parquet(path).select(by, "batch", F.lit(kept).alias("kept"))
    rows = one(good, True).unionByName(one(rejected, False))
    counts = [F.count_if("kept").alias("n_good"), F.count_if(~F.col("kept")).alias("n_rejected"), F.countDistinct("batch").alias("n_batches")]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_read"), *counts)
