"""Queries over streams: run to the end of what is there, so rows of windows that are still open don't appear."""

from __future__ import annotations

from pyspark.sql import functions as F

from robolake.functions.columns import micros
from robolake.functions.scratch import shared_folder
from robolake.sources.tables import load
from robolake.streaming import jobs

from .release import DEGRADE

QUERIES, SQL = {}, {}


#: Append mode gives a window once the watermark, an hour before the last event, has passed its end.
MARK = "(SELECT epoch_us(max(ts)) - 3600000000 FROM events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _micros(df, *cols):
    return df.withColumns({c: micros(c) for c in cols})


def _drained(spark, df, mode="append"):
    at = shared_folder(spark, "stream")
    return jobs.drain(df, f"{at}/out", f"{at}/checkpoint", mode)


@query("s1_tumbling", f"""
SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events
WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= {MARK} GROUP BY ALL""")
def s1_tumbling(spark, d):
    return _micros(_drained(spark, jobs.tumbling(jobs.events(spark, d), "1 hour", "1 hour")), "start").withColumn("mean", F.round("mean", 6))


@query("s2_sliding", f"""
WITH w AS (SELECT (epoch_us(ts) // 900000000 - k) * 900000000 AS start FROM events, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT start, count(*) AS n FROM w WHERE start + 3600000000 <= {MARK} GROUP BY start""")
def s2_sliding(spark, d):
    return _micros(_drained(spark, jobs.sliding(jobs.events(spark, d), "1 hour", "1 hour", "15 minutes")), "start")


@query("s3_session", f"""
WITH x AS (SELECT user_id, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800000000, true)::INT AS s FROM events),
     y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(us) AS start, max(us) + 1800000000 AS "end", count(*) AS n FROM y GROUP BY user_id, k HAVING max(us) + 1800000000 <= {MARK}""")
def s3_session(spark, d):
    return _micros(_drained(spark, jobs.sessions(jobs.events(spark, d), "1 hour", "30 minutes")), "start", "end")


@query("s4_interval_join", """
SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS
WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def s4_interval_join(spark, d):
    e = jobs.events(spark, d)
    return _drained(
        spark,
        jobs.interval_join(e.filter("event_type = 'view'"), jobs.events(spark, d).filter("event_type = 'purchase'"), "1 hour", "6 HOURS")
    )


#: Files that s5_once takes one after the other; a day of a user lies in several of them.
FILES = 8


@query("s5_once", "SELECT DISTINCT user_id, event_type, (epoch_us(ts) // 86400000000) * 86400000000 AS day FROM events")
def s5_once(spark, d):
    """A kind of event once a user and day, over as many micro-batches as files; rows of a day come within the watermark, a day."""
    at = shared_folder(spark, "files")
    jobs.in_files(load(spark, d, "events"), at, FILES)
    e = jobs.from_files(spark, at).withColumn("day", F.date_trunc("day", "ts"))
    return _micros(_drained(spark, jobs.once(e, "1 day", ("user_id", "event_type", "day")).select("user_id", "event_type", "day")), "day")


#: Microseconds of a recovering silence.
SILENCE = 48 * 3600 * 1_000_000


@query("c41b_recovery", f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, (event_type = 'error')::INT AS bad FROM events),
     g AS (SELECT *, coalesce(us - lag(us) OVER w > {SILENCE}, true)::INT AS fresh, lead(us) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
     r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS part FROM g),
     k AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id, part ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r),
     n AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, part, run ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM k)
SELECT user_id, us, event_id, CASE WHEN n >= 3 THEN 'STOPPED' WHEN n >= 2 THEN 'DEGRADED' ELSE 'NORMAL' END AS state FROM n
UNION ALL SELECT user_id, us + {SILENCE}, NULL, 'RECOVERED' FROM g WHERE next - us > {SILENCE} OR (next IS NULL AND us + {SILENCE} < {MARK})""")
def c41b_recovery(spark, d):
    """Over eight files one after the other, so state and timers go from batch to batch."""
    at = shared_folder(spark, "files")
    jobs.in_files(load(spark, d, "events"), at, FILES)
    with jobs.with_rocksdb(spark):
        return _drained(spark, jobs.recovery(jobs.from_files(spark, at), "1 hour", 2, 3, SILENCE))


_LATE = f"""s AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events),
     f AS (SELECT *, (us - lo) * {FILES} // (hi - lo + 1) + CASE WHEN event_id % 10 = 0 AND (us - lo) * {FILES} // (hi - lo + 1) < {FILES - 3} THEN 3 ELSE 0 END AS file,
                  (us // 3600000000) * 3600000000 AS start FROM s),
     m AS (SELECT a.file, max(b.us) // 1000 * 1000 - 3600000000 AS mark FROM (SELECT DISTINCT file FROM f) a LEFT JOIN f b ON b.file < a.file GROUP BY a.file),
     l AS (SELECT f.*, coalesce(start + 3600000000 <= mark, false) AS late FROM f JOIN m USING (file))"""


def _late(spark, d):
    """The events in eight files by time, but every tenth of the first five comes three files late; counts of each hour."""
    at, rows = shared_folder(spark, "late"), load(spark, d, "events")
    span = jobs.span_of(rows, FILES)
    jobs.in_files(rows, at, FILES, span + F.when((F.col("event_id") % 10 == 0) & (span < FILES - 3), 3).otherwise(0))
    counts = jobs.tumbling(jobs.from_files(spark, at), "1 hour", "1 hour")
    return jobs.progress_of(counts, f"{at}-out/rows", f"{at}-out/checkpoint")


@query("s1_late", f"""
WITH {_LATE} SELECT start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM l WHERE NOT late AND start + 3600000000 <= {MARK} GROUP BY ALL""")
def s1_late(spark, d):
    """What comes after the watermark has passed its hour isn't counted."""
    return _micros(_late(spark, d)[0], "start").withColumn("mean", F.round("mean", 6))


@query("s1_dropped", f"""
WITH {_LATE} SELECT (SELECT count(*) FROM (SELECT DISTINCT file, start, event_type FROM l WHERE late)) AS n_dropped, count(DISTINCT file) AS n_batches FROM l""")
def s1_dropped(spark, d):
    """What the query's progress says was dropped: the partial counts (batch, hour, kind) that came too late, and how many batches had rows."""
    _, reports = _late(spark, d)
    batches = sum(p["numInputRows"] > 0 for p in reports)
    return spark.createDataFrame([(jobs.dropped(reports), batches)], "n_dropped long, n_batches long")


@query("c43a_stream", f"""
WITH b AS (SELECT (epoch_us(ts) // 21600000000) * 21600000000 AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') / count(*) AS rate FROM events GROUP BY 1),
     h AS (SELECT a.bucket, any_value(a.n) AS n, any_value(a.rate) AS rate, avg(p.rate) AS baseline FROM b a LEFT JOIN b p ON p.bucket < a.bucket AND p.bucket >= a.bucket - 8 * 21600000000 GROUP BY a.bucket)
SELECT bucket, n, round(rate, 6) AS rate, round(baseline, 6) AS baseline, coalesce(round(rate - baseline - 0.05::DOUBLE, 9) > 0, false) AS alert FROM h WHERE bucket + 21600000000 <= {MARK}""")
def c43a_stream(spark, d):
    """c43a_health as a stream over eight files."""
    at = shared_folder(spark, "files")
    jobs.in_files(load(spark, d, "events"), at, FILES)
    told = _drained(spark, jobs.health(jobs.from_files(spark, at), "1 hour", 6, 8, 0.05))
    return _micros(told, "bucket").withColumns({c: F.round(c, 6) for c in ("rate", "baseline")})


@query("c11_ingest", """
SELECT event_type, count(*) AS n_read, count(*) FILTER (value >= 10) AS n_good, count(*) FILTER (NOT coalesce(value >= 10, false)) AS n_rejected, 1::BIGINT AS n_batches
FROM events GROUP BY event_type""")
def c11_ingest(spark, d):
    """The incremental pipeline: a second run finds nothing new, so each row stands once, in the good table or in quarantine."""
    at = shared_folder(spark, "ingest")
    for _ in range(2):
        jobs.ingest(jobs.events(spark, d), f"{at}/good", f"{at}/rejected", f"{at}/checkpoint", "value >= 10")
    return jobs.ingested(spark, f"{at}/good", f"{at}/rejected", "event_type")


@query("s6_degrade", f"WITH {DEGRADE} SELECT entity AS user_id, id AS event_id, CASE WHEN n >= 3 THEN 'STOPPED' WHEN n >= 2 THEN 'DEGRADED' ELSE 'NORMAL' END AS state FROM n")
def s6_degrade(spark, d):
    return _drained(spark, jobs.degrade(jobs.events(spark, d).select("user_id", "event_id", "ts", "event_type"), 2, 3))
