"""Queries of the evaluation layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from robolake.functions.columns import r6
from robolake.operators import evaluation
from robolake.sources.tables import trials

QUERIES, SQL = {}, {}
Z = "1.959963984540054::DOUBLE"
TRIALS = """t AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'base' ELSE 'cand' END AS version, event_type AS cell, user_id % 3 AS repeat, value > 50 AS success,
       value AS latency, epoch_us(ts) AS us, user_id AS entity, event_id AS id FROM events)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def bound(k: str, n: str, sign: str) -> str:
    p, n = f"({k} / {n}::DOUBLE)", f"({n}::DOUBLE)"
    return f"(({p} + {Z}*{Z}/(2*{n})) {sign} {Z} * sqrt({p}*(1-{p})/{n} + {Z}*{Z}/(4*{n}*{n}))) / (1 + {Z}*{Z}/{n})"


@query("e1_wilson", f"""
WITH {TRIALS}, c AS (SELECT cell, count(*) AS n, count(*) FILTER (success) AS k FROM t GROUP BY cell)
SELECT cell, n, k, round(k / n, 6) AS p, round({bound('k', 'n', '-')}, 6) AS lo, round({bound('k', 'n', '+')}, 6) AS hi FROM c""")
def e1_wilson(spark, d):
    return evaluation.success_rate(trials(spark, d), ("cell",), "success").withColumns({c: r6(F.col(c)) for c in ("p", "lo", "hi")})


@query("e2_tail", f"WITH {TRIALS} SELECT cell, version, count(*) AS n, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95 FROM t GROUP BY cell, version")
def e2_tail(spark, d):
    return evaluation.tail(trials(spark, d), ("cell", "version"), "latency").withColumns({c: r6(F.col(c)) for c in ("p50", "p95")})


@query("e2_tail_approx", f"""
WITH {TRIALS}, r AS (SELECT cell, version, latency, row_number() OVER (PARTITION BY cell, version ORDER BY latency) AS k, count(*) OVER (PARTITION BY cell, version) AS n FROM t)
SELECT cell, version, any_value(n) AS n, min(latency) FILTER (k >= ceil(n * 0.5)) AS p50, min(latency) FILTER (k >= ceil(n * 0.95)) AS p95 FROM r GROUP BY cell, version""")
def e2_tail_approx(spark, d):
    return evaluation.tail_approx(trials(spark, d), ("cell", "version"), "latency")


@query("e3_regression", f"""
WITH {TRIALS}, c AS (SELECT cell, count(*) FILTER (version = 'base') AS nb, count(*) FILTER (version = 'base' AND success) AS kb,
       count(*) FILTER (version = 'cand') AS nc, count(*) FILTER (version = 'cand' AND success) AS kc FROM t GROUP BY cell)
SELECT cell, round(kc / nc - kb / nb, 6) AS delta, CASE WHEN nb = 0 OR nc = 0 THEN 'MISSING' WHEN {bound('kc', 'nc', '+')} < {bound('kb', 'nb', '-')} THEN 'REGRESSED' ELSE 'OK' END AS status FROM c""")
def e3_regression(spark, d):
    return evaluation.regression(trials(spark, d), "cell", "version", "success", "base", "cand").withColumn("delta", r6(F.col("delta")))


@query("e4_generalisation", f"""
WITH {TRIALS}, r AS (SELECT avg(success::INT) AS ref FROM t WHERE cell IN ('click', 'view') AND version = 'base')
SELECT cell, version, grouping(cell, version)::BIGINT AS grouping, count(*) AS n, round(avg(success::INT), 6) AS p, round(avg(success::INT) - any_value(ref), 6) AS degradation
FROM t, r GROUP BY CUBE (cell, version)""")
def e4_generalisation(spark, d):
    g = evaluation.generalisation(
        trials(spark, d), ("cell", "version"), "success", F.col("cell").isin("click", "view") & (F.col("version") == "base")
    )
    return g.withColumns({c: r6(F.col(c)) for c in ("p", "degradation")})


@query("e4_matrix", f"""
WITH {TRIALS} SELECT cell, round(avg(success::INT) FILTER (version = 'base'), 6) AS base, round(avg(success::INT) FILTER (version = 'cand'), 6) AS cand FROM t GROUP BY cell""")
def e4_matrix(spark, d):
    return evaluation.rate_table(
        trials(spark, d), "cell", "version", ("base", "cand"), "success"
    ).withColumns({c: r6(F.col(c)) for c in ("base", "cand")})


@query("e5_stability", f"""
WITH {TRIALS}, e AS (SELECT cell, repeat, avg(success::INT) AS p FROM t GROUP BY cell, repeat)
SELECT cell, count(*) AS n_repeats, round(max(p) - min(p), 6) AS spread FROM e GROUP BY cell""")
def e5_stability(spark, d):
    return evaluation.stability(trials(spark, d), "cell", "repeat", "success").withColumn("spread", r6(F.col("spread")))


@query("c30_cube", f"""
WITH {TRIALS} SELECT cell, version, repeat, grouping(cell, version, repeat)::BIGINT AS grouping, count(*) AS n, round(avg(success::INT), 6) AS p FROM t GROUP BY CUBE (cell, version, repeat)""")
def c30_cube(spark, d):
    return evaluation.eval_matrix(trials(spark, d), ("cell", "version", "repeat"), "success").withColumn("p", r6(F.col("p")))


@query("c28_gap", """
WITH e AS (SELECT value, (ts >= TIMESTAMP '2024-01-16')::INT AS s FROM events), l AS (SELECT min(value) AS lo, max(value) AS hi FROM e WHERE s = 0),
     b AS (SELECT greatest(least(CASE WHEN value = hi THEN 10 WHEN value < lo THEN 0 WHEN value > hi THEN 11 ELSE floor((value - lo) / (hi - lo) * 10)::BIGINT + 1 END, 10), 1) AS bin, s, value FROM e, l),
     c AS (SELECT bin, count(*) FILTER (s = 0) AS ca, count(*) FILTER (s = 1) AS cb, sum(value) FILTER (s = 0) AS sa, sum(value) FILTER (s = 1) AS sb FROM b GROUP BY bin),
     p AS (SELECT *, ca / sum(ca) OVER () AS pa, cb / sum(cb) OVER () AS pb FROM c),
     q AS (SELECT *, abs(sum(pa) OVER (ORDER BY bin) - sum(pb) OVER (ORDER BY bin)) AS gap, greatest(pa, 1e-6::DOUBLE) AS fa, greatest(pb, 1e-6::DOUBLE) AS fb FROM p)
SELECT round(sum((fa - fb) * ln(fa / fb)), 6) AS psi, round(max(gap), 6) AS ks, round(sum(sb) / sum(cb) - sum(sa) / sum(ca), 6) AS mean_gap FROM q""")
def c28_gap(spark, d):
    t = trials(spark, d)
    g = evaluation.distribution_gap(t.filter("version = 'base'"), t.filter("version = 'cand'"), "latency")
    return g.select(*[r6(F.col(c)).alias(c) for c in g.columns])
