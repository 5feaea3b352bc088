"""Streams run to the end give what the batch gives; windows are held against SQL with the other queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from robolake.plans import registry, streams
from robolake.sources.tables import load
from robolake.streaming import jobs


@pytest.fixture
def batch(spark, sf):
    return load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.select(*cols).collect()}


def test_interval_join(spark, sf, batch):
    want = jobs.interval_join(batch.filter("event_type = 'view'"), batch.filter("event_type = 'purchase'"), "1 hour", "6 HOURS")
    assert rows(registry.QUERIES["s4_interval_join"](spark, sf), "a_id", "b_id") == rows(want, "a_id", "b_id")


def test_once(spark, sf, batch):
    got = registry.QUERIES["s5_once"](spark, sf)
    want = batch.select("user_id", "event_type", F.date_trunc("day", "ts").alias("day")).distinct()
    assert got.count() == want.count() == got.distinct().count()


def test_state_machine_equals_batch(spark, sf):
    assert rows(registry.QUERIES["s6_degrade"](spark, sf), "event_id", "state") == rows(
        registry.QUERIES["c41b_degrade"](spark, sf).withColumnRenamed("id", "event_id"), "event_id", "state"
    )


def test_state_goes_on_between_runs(spark, sf, tmp_path):
    e = jobs.events(spark, sf).select("user_id", "event_id", "ts", "event_type")
    first = jobs.drain(jobs.degrade(e, 2, 3), str(tmp_path / "out"), str(tmp_path / "c")).count()
    assert jobs.drain(jobs.degrade(e, 2, 3), str(tmp_path / "out"), str(tmp_path / "c")).count() == first
    assert streams.QUERIES


def told(batches, silence, warn=2, stop=3, mark=None):
    """Rows of Recovery for a user's (us, id, kind) in order, and the recovery after the last one if the watermark has passed it."""
    n, last, out = 0, None, []
    for us, i, kind in batches:
        if last is not None and us - last > silence:
            out.append((last + silence, None, "RECOVERED"))
            n = 0
        n, last = n + 1 if kind == "error" else 0, us
        out.append((us, i, "STOPPED" if n >= stop else "DEGRADED" if n >= warn else "NORMAL"))
    if last is not None and mark is not None and last + silence < mark:
        out.append((last + silence, None, "RECOVERED"))
    return out


def test_recovery_goes_on_after_a_restart(spark, tmp_path):
    """The first files in one run, the others in a second from the same checkpoint: errors in a row and timers are carried, as if it were one run."""
    import random

    rng, minute = random.Random(5), 60_000_000
    rows_, t = [], 0
    for i in range(240):
        t += rng.choice((1, 5, 20, 90)) * minute
        rows_.append((i, t, rng.randrange(4), rng.choice(("error", "error", "view"))))
    rows_.append((999, t + 10_000 * minute, 77, "view"))  # lets all timers end
    df = spark.createDataFrame(rows_, "event_id long, us long, user_id long, event_type string")
    events = df.selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) as ts", "user_id", "event_type", "0d as value", "'' as props")
    folder, out, check = (str(tmp_path / x) for x in ("files", "out", "check"))
    number = jobs.span_of(events, 6)
    with jobs.with_rocksdb(spark):
        for part in (number < 3, number >= 3):
            jobs.in_files(events.filter(part), folder, 6, number)
            got = jobs.drain(jobs.recovery(jobs.from_files(spark, folder), "1 minute", 2, 3, 60 * minute), out, check)
    mark = t + 10_000 * minute - minute
    want = []
    for user in (0, 1, 2, 3, 77):
        mine = [(us, i, kind) for i, us, u, kind in rows_ if u == user]
        want += [(user, *r) for r in told(mine, 60 * minute, mark=mark)]
    assert sorted(((r["user_id"], r["us"], r["event_id"], r["state"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[3] == "RECOVERED" for r in want) > 20


def test_late_rows_are_dropped_and_counted(spark, sf):
    late = registry.QUERIES["s1_late"](spark, sf).agg(F.sum("n")).first()[0]
    whole = registry.QUERIES["s1_tumbling"](spark, sf).agg(F.sum("n")).first()[0]
    assert late < whole and registry.QUERIES["s1_dropped"](spark, sf).first()["n_dropped"] > 0
