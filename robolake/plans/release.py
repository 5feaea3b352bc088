"""Queries of integration, faults, release and acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from robolake.functions.columns import micros, r6
from robolake.functions.scratch import shared_folder
from robolake.operators import release, timeline
from robolake.sources.tables import load, readings, trials

from .evaluation import TRIALS

H = timeline.SECOND * 3600
DAY = 24 * H
QUERIES, SQL = {}, {}
E = "e AS (SELECT user_id AS entity, event_type AS channel, epoch_us(ts) AS us, value, event_id AS id FROM events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query("c41a_contract", """
SELECT 'discount' AS rule, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.08) AS n_violations FROM lineitem
UNION ALL SELECT 'flag', count(*) FILTER (NOT l_returnflag IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 'order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)""")
def c41a_contract(spark, d):
    rules = {"discount": F.col("l_discount").between(0, 0.08), "flag": F.col("l_returnflag").isin("A", "N")}
    refs = {
        "order": ("l_orderkey", load(spark, d, "orders"), "o_orderkey"),
        "part": ("l_partkey", load(spark, d, "part").filter("p_size > 2"), "p_partkey")
    }
    return release.contract_audit(load(spark, d, "lineitem"), rules, refs)


@query("c41a_types", """
WITH e AS (SELECT props->>'$.k' AS k, event_type, value::VARCHAR AS value, split_part(value::VARCHAR, '.', 1) AS whole FROM events)
SELECT 'k' AS rule, count(k) AS n_values, count(*) FILTER (k IS NOT NULL AND TRY_CAST(k AS INT) IS NULL) AS n_violations FROM e
UNION ALL SELECT 'kind', count(event_type), count(*) FILTER (event_type IS NOT NULL AND TRY_CAST(event_type AS DOUBLE) IS NULL) FROM e
UNION ALL SELECT 'small', count(whole), count(*) FILTER (whole IS NOT NULL AND TRY_CAST(whole AS TINYINT) IS NULL) FROM e""")
def c41a_types(spark, d):
    e = load(spark, d, "events")
    rules = {
        "k": (F.get_json_object("props", "$.k"), "int"), "kind": (F.col("event_type"), "double"),
        "small": (F.split_part(F.col("value").cast("string"), F.lit("."), F.lit(1)), "tinyint"),
    }
    return release.type_violations(e, rules)


DEGRADE = f"""{E}, r AS (SELECT *, (channel = 'error')::INT AS bad, sum(1 - (channel = 'error')::INT) OVER (PARTITION BY entity ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS run FROM e),
     n AS (SELECT *, sum(bad) OVER (PARTITION BY entity, run ORDER BY us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM r)"""


@query("c41b_degrade", f"WITH {DEGRADE} SELECT entity, id, n AS errors_in_a_row, CASE WHEN n >= 3 THEN 'STOPPED' WHEN n >= 2 THEN 'DEGRADED' ELSE 'NORMAL' END AS state FROM n")
def c41b_degrade(spark, d):
    return release.degrade(
        readings(spark, d), "entity", "us", "id", F.col("channel") == "error", 2, 3
    ).select("entity", "id", "errors_in_a_row", "state")


_RUNS = """a AS (SELECT user_id, event_type, round(value, 3) AS value FROM events),
     b AS (SELECT user_id, event_type, round(CASE WHEN event_id % 50 = 0 THEN value + 1 ELSE value END, 3) AS value FROM events)"""


def _runs(spark, d):
    """The events as one run, and as another whose every fiftieth value is off."""
    e = load(spark, d, "events")
    off = F.when(F.col("event_id") % 50 == 0, F.col("value") + 1).otherwise(F.col("value"))
    return [e.select("user_id", "event_type", F.round(v, 3).alias("value")) for v in (F.col("value"), off)]


@query("c41c_replay", f"""
WITH {_RUNS} SELECT *, 'only_a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'only_b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def c41c_replay(spark, d):
    return release.replay_diff(*_runs(spark, d))


@query("c41c_keys", f"""
WITH {_RUNS}, d AS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)),
     n AS (SELECT user_id, sum(x)::BIGINT AS n_a, sum(y)::BIGINT AS n_b FROM (SELECT user_id, 1 AS x, 0 AS y FROM a UNION ALL SELECT user_id, 0, 1 FROM b) GROUP BY user_id)
SELECT user_id, n_a, n_b, user_id NOT IN (SELECT user_id FROM d) AS same FROM n""")
def c41c_keys(spark, d):
    return release.replay_keys(*_runs(spark, d), "user_id", ("event_type", "value"))


TICKETS = """x AS (SELECT entity, us, id, coalesce(us - lag(us) OVER (PARTITION BY entity ORDER BY us, id) > {gap}, true)::INT AS s FROM e WHERE channel = 'error'),
     y AS (SELECT *, sum(s) OVER (PARTITION BY entity ORDER BY us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS ticket FROM x),
     k AS (SELECT entity, ticket, min(us) AS first_us, max(us) AS last_us, count(*) AS n_events FROM y GROUP BY entity, ticket)"""


def _tickets(spark, d, gap):
    return timeline.tickets(readings(spark, d).filter("channel = 'error'"), "entity", "us", "id", gap)


@query("c42a_session", f"WITH {E}, {TICKETS.format(gap=24 * H)} SELECT * FROM k")
def c42a_session(spark, d):
    return _tickets(spark, d, 24 * H)


@query("c42b_triage", """
SELECT coalesce(CASE WHEN value IS NULL THEN 'no_reading' END, CASE WHEN value > 95 THEN 'overload' END, CASE WHEN event_type = 'error' THEN 'software' END, CASE WHEN value < 5 THEN 'sensor' END, 'healthy') AS layer, count(*) AS n FROM events GROUP BY 1""")
def c42b_triage(spark, d):
    rules = [
        ("no_reading", F.col("value").isNull()), ("overload", F.col("value") > 95), ("software", F.col("channel") == "error"),
        ("sensor", F.col("value") < 5)
    ]
    return readings(spark, d).groupBy(timeline.first_match(rules, "healthy").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("c42c_cases", f"""
WITH {E}, c AS (SELECT entity, id, us, CASE WHEN value > 75 THEN 'power' WHEN value > 25 THEN 'motion' ELSE 'network' END AS cause FROM e WHERE channel = 'error'),
     a AS (SELECT cause, coalesce(lead(us) OVER (PARTITION BY entity, cause ORDER BY us, id) - us <= {7 * DAY}, false)::INT AS again FROM c)
SELECT cause, count(*) AS n, round(avg(again), 6) AS recurrence, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM a GROUP BY cause""")
def c42c_cases(spark, d):
    c = readings(spark, d).filter("channel = 'error'").withColumn(
        "cause", F.when(F.col("value") > 75, "power").when(F.col("value") > 25, "motion").otherwise("network")
    )
    return _rounded(release.case_stats(c, "entity", "cause", "us", "id", 7 * DAY), "recurrence", "share")


@query("c43a_health", f"""
WITH {E}, b AS (SELECT (us // {6 * H}) * {6 * H} AS bucket, count(*) AS n, avg((channel = 'error')::INT) AS rate FROM e GROUP BY 1),
     h AS (SELECT *, avg(rate) OVER (ORDER BY bucket ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS baseline FROM b)
SELECT bucket, n, round(rate, 6) AS rate, round(baseline, 6) AS baseline, coalesce(round(rate - baseline - 0.05::DOUBLE, 9) > 0, false) AS alert FROM h""")
def c43a_health(spark, d):
    return _rounded(release.health(readings(spark, d), "us", 6 * H, F.col("channel") == "error", 8, 0.05), "rate", "baseline")


@query("c43b_canary", f"""
WITH {TRIALS}, c AS (SELECT cell, count(*) FILTER (version = 'base') AS nb, count(*) FILTER (version = 'base' AND NOT success) AS kb, count(*) FILTER (version = 'cand') AS nc, count(*) FILTER (version = 'cand' AND NOT success) AS kc FROM t GROUP BY cell),
     d AS (SELECT *, round(kc / nc - kb / nb, 9) AS delta FROM c)
SELECT cell, nb, nc, delta, CASE WHEN nb < 30 OR nc < 30 THEN 'WATCH' WHEN delta <= 0.0 THEN 'PASS' WHEN delta <= 0.02 THEN 'WATCH' ELSE 'ROLLBACK' END AS verdict FROM d""")
def c43b_canary(spark, d):
    return release.canary(trials(spark, d), "cell", "version", "base", "cand", ~F.col("success"), 0.0, 0.02, 30)


@query("c43c_rollback", f"""
WITH {E}, b AS (SELECT (us // {DAY}) * {DAY} AS bucket, round(avg((channel = 'error')::INT), 9) AS rate FROM e GROUP BY 1),
     v AS (SELECT bucket, CASE WHEN rate <= 0.2 THEN 'PASS' WHEN rate <= 0.22 THEN 'WATCH' ELSE 'ROLLBACK' END AS v FROM b), f AS (SELECT min(bucket) FILTER (v = 'ROLLBACK') AS rollback FROM v)
SELECT rollback, max(bucket) FILTER (v = 'PASS' AND bucket < rollback) AS last_good FROM v, f GROUP BY rollback""")
def c43c_rollback(spark, d):
    b = readings(spark, d).groupBy((F.floor(F.col("us") / DAY) * DAY).cast("long").alias("bucket")).agg(
        F.round(F.avg((F.col("channel") == "error").cast("double")), 9).alias("rate")
    )
    return release.rollback_point(b, "bucket", F.when(F.col("rate") <= 0.2, "PASS").when(F.col("rate") <= 0.22, "WATCH").otherwise("ROLLBACK"))


@query("c43d_budget", f"""
WITH {E}, b AS (SELECT (us // {DAY}) * {DAY} AS bucket, count(*) AS n, count(*) FILTER (channel = 'error') AS failures FROM e GROUP BY 1),
     s AS (SELECT *, (sum(failures) OVER (ORDER BY bucket))::BIGINT AS spent, (1 - 0.9::DOUBLE) * sum(n) OVER () AS whole FROM b)
SELECT bucket, n, failures, spent, round(spent / whole, 6) AS burn, spent / whole > 1 AS exhausted FROM s""")
def c43d_budget(spark, d):
    return _rounded(release.error_budget(readings(spark, d), "us", DAY, F.col("channel") == "error", 0.9), "burn")


@query("c43e_review", f"""
WITH {E}, {TICKETS.format(gap=24 * H)}
SELECT k.entity, k.ticket, round(avg(e.value) FILTER (e.us < first_us), 6) AS before, round(avg(e.value) FILTER (e.us BETWEEN first_us AND last_us), 6) AS during, round(avg(e.value) FILTER (e.us > last_us), 6) AS after
FROM k JOIN e ON e.entity = k.entity AND e.us BETWEEN first_us - {12 * H} AND last_us + {12 * H} GROUP BY k.entity, k.ticket""")
def c43e_review(spark, d):
    return _rounded(
        release.incident_review(_tickets(spark, d, 24 * H), readings(spark, d), "entity", "us", "value", 12 * H, 12 * H), "before",
        "during", "after"
    )


_LIMITS = {"success": (0.45, 0.52), "volume": (20.0, 30.0), "uptime": (0.75, 0.8)}


def _metrics(spark, d):
    m = trials(spark, d).groupBy("entity").agg(
        F.round(F.avg(F.col("success").cast("double")), 9).alias("success"), F.count(F.lit(1)).cast("double").alias("volume"),
        F.round(F.avg((F.col("cell") != "error").cast("double")), 9).alias("uptime")
    )
    return m.unpivot("entity", list(_LIMITS), "metric", "value")


def _level(m):
    return f"CASE WHEN {m} >= {_LIMITS[m][1]} THEN 0 WHEN {m} >= {_LIMITS[m][0]} THEN 1 ELSE 2 END"


@query("c44a_gate", f"""
WITH {TRIALS}, m AS (SELECT entity, round(avg(success::INT), 9) AS success, count(*)::DOUBLE AS volume, round(avg((cell <> 'error')::INT), 9) AS uptime FROM t GROUP BY entity),
     l AS (SELECT entity, [{', '.join(_level(m) for m in _LIMITS)}] AS l FROM m)
SELECT entity, len(list_filter(l, lambda x: x = 0))::BIGINT AS n_pass, len(list_filter(l, lambda x: x = 1))::BIGINT AS n_yellow, len(list_filter(l, lambda x: x = 2))::BIGINT AS n_fail, ['PASS', 'YELLOW', 'FAIL'][list_max(l) + 1] AS verdict FROM l""")
def c44a_gate(spark, d):
    return release.acceptance(_metrics(spark, d), _LIMITS)


_ROW = ("event_id", "us", "event_type", "value", "props")
_FRAMED = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _ROW)


@query("c44b_evidence", f"""
WITH h AS (SELECT user_id, event_id, event_id // {release.LINK} AS l, sha256({_FRAMED}) AS h FROM (SELECT *, epoch_us(ts) AS us FROM events)),
     k AS (SELECT user_id, l, count(*) AS n, sha256(string_agg(h, '' ORDER BY event_id)) AS h FROM h GROUP BY user_id, l)
SELECT user_id, sum(n)::BIGINT AS n_rows, sha256(string_agg(h, '' ORDER BY l)) AS chain FROM k GROUP BY user_id""")
def c44b_evidence(spark, d):
    return release.evidence(load(spark, d, "events").withColumn("us", micros("ts")), "user_id", _ROW, "event_id")


@query(
    "c44b_sources",
    f"WITH v AS ({SQL['c44a_gate']}) SELECT user_id AS entity, event_id, event_type, value, verdict FROM events JOIN v ON entity = user_id"
)
def c44b_sources(spark, d):
    rows = load(spark, d, "events").withColumnRenamed("user_id", "entity")
    return release.source_rows(c44a_gate(spark, d), rows, "entity", ("event_id", "event_type", "value"))


def _lines(texts: tuple[str, ...], first: int) -> str:
    return " UNION ALL ".join(f"SELECT {first + i} AS part, NULL AS cell, '{t}' AS text" for i, t in enumerate(texts))


@query("c44c_report", f"""
WITH v AS ({SQL['c43b_canary']}),
     l AS ({_lines(('# Acceptance report', '', '| cell | nb | nc | delta | verdict |', '| --- | --- | --- | --- | --- |'), 1)}
           UNION ALL SELECT 5, cell, '| ' || cell || ' | ' || nb || ' | ' || nc || ' | ' || verdict || ' |' FROM v
           UNION ALL {_lines(('', '## Sign-off', '', '| Role | Name | Date |', '| --- | --- | --- |', '| Test |  |  |', '| Release |  |  |'), 6)})
SELECT row_number() OVER (ORDER BY part, cell) AS line, text FROM l""".replace("delta | ", "", 1).replace("| --- | --- | --- | --- | --- |", "| --- | --- | --- | --- |"))
def c44c_report(spark, d):
    return release.report_md(c43b_canary(spark, d).select("cell", "nb", "nc", "verdict"), "Acceptance report")


@query("c44c_file", "SELECT count(*) + 11 AS n_lines, count(*) AS n_verdicts, true AS signed FROM (SELECT DISTINCT event_type FROM events)")
def c44c_file(spark, d):
    """The report written to a file and read back."""
    path = shared_folder(spark, "report")
    release.write_report(c44c_report(spark, d), path)
    lines = spark.read.text(path)
    verdict = F.col("value").rlike(r"\| (PASS|WATCH|ROLLBACK) \|$")
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(verdict).alias("n_verdicts"), (F.count_if(F.col("value") == "## Sign-off") == 1).alias("signed"))


@query("c44d_gates", f"""
WITH {E}, g AS (SELECT entity, count(*) >= 10 AS g0, count(*) FILTER (channel = 'signup') > 0 AS g1, avg(value) > 45 AS g2, avg((channel = 'error')::INT) < 0.21 AS g3, max(value) > 95 AS g4 FROM e GROUP BY entity),
     n AS (SELECT entity, (CASE WHEN NOT g0 THEN 0 WHEN NOT g1 THEN 1 WHEN NOT g2 THEN 2 WHEN NOT g3 THEN 3 WHEN NOT g4 THEN 4 ELSE 5 END)::BIGINT AS n_gates FROM g)
SELECT entity, n_gates, CASE WHEN n_gates > 0 THEN 'G' || (n_gates - 1) END AS gate FROM n""")
def c44d_gates(spark, d):
    gates = [
        ("G0", F.count(F.lit(1)) >= 10), ("G1", F.count_if(F.col("channel") == "signup") > 0), ("G2", F.avg("value") > 45),
        ("G3", F.avg((F.col("channel") == "error").cast("double")) < 0.21), ("G4", F.max("value") > 95)
    ]
    return release.gate_board(readings(spark, d), "entity", gates)
