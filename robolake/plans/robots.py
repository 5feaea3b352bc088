"""Queries of the model, simulation and hardware layers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from robolake.functions import mergeable
from robolake.functions.columns import hash_mod, r6
from robolake.operators import evaluation, ledger, quality, recursive, timeline
from robolake.sources.tables import costs, load, readings, transitions

H = timeline.SECOND * 3600
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


#: Fifty events, whatever their kind, are an image, so images grow in number with the table.
_BOX = "event_id // 50 AS image, (event_id % 7)::DOUBLE AS x0, (event_id % 5)::DOUBLE AS y0, (event_id % 7 + 4 + event_id % 3)::DOUBLE AS x1, (event_id % 5 + 4 + event_id % 2)::DOUBLE AS y1"


def _boxes(spark, d, which):
    i = F.col("event_id")
    e = load(spark, d, "events").filter(F.col("event_type") == which)
    dbl = lambda c: c.cast("double")
    return e.select(
        i.alias("id"), F.expr("event_id div 50").alias("image"), dbl(i % 7).alias("x0"), dbl(i % 5).alias("y0"), dbl(i % 7 + 4 + i % 3).alias("x1"),
        dbl(i % 5 + 4 + i % 2).alias("y1"), (hash_mod(i, 1000) / 1000).alias("conf")
    )


@query("c13_detection", f"""
WITH RECURSIVE p AS (SELECT event_id AS id, {_BOX}, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 1000 / 1000 AS conf FROM events WHERE event_type = 'view'),
     t AS (SELECT event_id AS tid, {_BOX} FROM events WHERE event_type = 'purchase'),
     m AS (SELECT p.image, p.id, p.conf, t.tid, greatest(least(p.x1, t.x1) - greatest(p.x0, t.x0), 0) * greatest(least(p.y1, t.y1) - greatest(p.y0, t.y0), 0) AS i,
                  (p.x1 - p.x0) * (p.y1 - p.y0) AS ar, (t.x1 - t.x0) * (t.y1 - t.y0) AS br FROM p JOIN t USING (image)),
     b AS (SELECT image, id, conf, tid, i / (ar + br - i) AS o FROM m WHERE i / (ar + br - i) >= 0.5),
     c AS (SELECT image, id, list(tid ORDER BY o DESC, tid) AS tids, row_number() OVER (PARTITION BY image ORDER BY any_value(conf) DESC, id) AS k FROM b GROUP BY image, id),
     g AS (SELECT image, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS id, NULL::BIGINT AS tid FROM c WHERE k = 1
           UNION ALL SELECT image, k, CASE WHEN x IS NULL THEN taken ELSE list_append(taken, x) END, id, x
           FROM (SELECT c.image, c.k, c.id, g.taken, list_filter(c.tids, lambda t: NOT list_contains(g.taken, t))[1] AS x FROM g JOIN c ON c.image = g.image AND c.k = g.k + 1)),
     r AS (SELECT id FROM g WHERE tid IS NOT NULL),
     q AS (SELECT p.id, p.conf, CASE WHEN r.id IS NULL THEN 0 ELSE 1 END AS hit FROM p LEFT JOIN r ON p.id = r.id),
     a AS (SELECT *, sum(hit) OVER w AS tp, count(*) OVER w AS k FROM q WINDOW w AS (ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING))
SELECT count(*) AS n_pred, (SELECT count(*) FROM t) AS n_truth, sum(hit)::BIGINT AS tp, round(sum(hit) / count(*), 6) AS precision, round(sum(hit) / (SELECT count(*) FROM t), 6) AS recall,
       round(sum(CASE WHEN hit = 1 THEN tp / k ELSE 0 END) / (SELECT count(*) FROM t), 6) AS ap FROM a""")
def c13_detection(spark, d):
    r = evaluation.detections(_boxes(spark, d, "view"), _boxes(spark, d, "purchase").drop("conf"), "image", 0.5)
    return _rounded(r, "precision", "recall", "ap")


@query("c14_pose", """
WITH p AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS a, [embedding[1]::DOUBLE + 0.01::DOUBLE, embedding[2]::DOUBLE, embedding[4]::DOUBLE] AS b FROM embeddings),
     q AS (SELECT vec_id, sqrt((a[1]-b[1])*(a[1]-b[1]) + (a[2]-b[2])*(a[2]-b[2]) + (a[3]-b[3])*(a[3]-b[3])) AS e, sqrt(b[1]*b[1] + b[2]*b[2] + b[3]*b[3]) AS n,
                  a[1]*b[1] + a[2]*b[2] + a[3]*b[3] AS dot, sqrt(a[1]*a[1] + a[2]*a[2] + a[3]*a[3]) AS m FROM p)
SELECT vec_id, round(e, 6) AS error, round(e / n, 6) AS relative, round(degrees(acos(greatest(least(dot / (m * n), 1), -1))), 4) AS angle FROM q""")
def c14_pose(spark, d):
    v = load(spark, d, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    pred = v.select("vec_id", F.array(at(1), at(2), at(3)).alias("v"))
    truth = v.select("vec_id", F.array(at(1) + 0.01, at(2), at(4)).alias("v"))
    return _rounded(evaluation.vector_errors(pred, truth, "vec_id", "v"), "error", "relative").withColumn("angle", F.round("angle", 4))


@query("c14_rmse", """
WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
     q AS (SELECT label, a, list_transform(a, lambda x, i: x + 0.01::DOUBLE * (i % 3)) AS b FROM p),
     e AS (SELECT label, len(a) AS d, sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS e,
                  list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS c FROM q)
SELECT label, count(*) AS n, round(sqrt(sum(e * e) / sum(d)), 6) AS rmse, round(avg(e), 6) AS mean_error, round(max(degrees(acos(greatest(least(c, 1), -1)))), 4) AS max_angle FROM e GROUP BY label""")
def c14_rmse(spark, d):
    pred = load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    truth = pred.select("vec_id", F.transform("v", lambda x, i: x + 0.01 * ((i + 1) % 3)).alias("v"))
    return _rounded(evaluation.pose_summary(pred, truth, "vec_id", "v", "label"), "rmse", "mean_error").withColumn("max_angle", F.round("max_angle", 4))


@query("c15_fuse", f"""
WITH {E}, v AS (SELECT entity, value, CASE channel WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 ELSE 4.0 END::DOUBLE AS var FROM e)
SELECT entity, round(sum(value / var) / sum(1 / var), 6) AS fused, round(1 / sum(1 / var), 6) AS variance FROM v GROUP BY entity""")
def c15_fuse(spark, d):
    r = readings(spark, d).withColumn("var", F.when(F.col("channel") == "view", 1.0).when(F.col("channel") == "click", 2.0).otherwise(4.0))
    return _rounded(evaluation.fuse(r, "entity", "value", "var"), "fused", "variance")


@query("c15_filter", f"""
WITH RECURSIVE {E}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us, id) AS k FROM e),
     r AS (SELECT entity, us, id, k, value AS x, 25.0::DOUBLE AS p FROM o WHERE k = 1
           UNION ALL SELECT o.entity, o.us, o.id, o.k, r.x + (r.p + 1) / (r.p + 1 + 25) * (o.value - r.x), (1 - (r.p + 1) / (r.p + 1 + 25)) * (r.p + 1) FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1)
SELECT entity, us, id, round(x, 6) AS estimate, round(p, 6) AS variance FROM r""")
def c15_filter(spark, d):
    return _rounded(recursive.kalman(readings(spark, d), "entity", ("us", "id"), "value", 1.0, 25.0), "estimate", "variance")


@query("c16_predict", f"""
WITH {E}, w AS (SELECT entity, us, id, value, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(us, 1) OVER w AS t1, lag(us, 2) OVER w AS t2 FROM e WINDOW w AS (PARTITION BY entity ORDER BY us, id)),
     p AS (SELECT entity, us, id, abs(value - (v1 + (v1 - v2) / nullif((t1 - t2)::DOUBLE, 0) * (us - t1))) AS error FROM w)
SELECT entity, round(avg(error), 3) AS ade, round(arg_max(error, us), 3) AS fde FROM p WHERE error IS NOT NULL GROUP BY entity""")
def c16_predict(spark, d):
    e = timeline.displacement_errors(timeline.predict_linear(readings(spark, d), "entity", "us", "id", "value"), "entity", "us", "id")
    return e.withColumns({c: F.round(c, 3) for c in ("ade", "fde")})


_T = "t AS (SELECT channel AS src, dst, count(*) AS w FROM (SELECT channel, lead(channel) OVER (PARTITION BY entity ORDER BY us, id) AS dst FROM e) WHERE dst IS NOT NULL GROUP BY ALL)"


@query("c17_reachable", f"""
WITH RECURSIVE {E}, {_T}, s AS (SELECT src, dst FROM t QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 1),
     r AS (SELECT 'click' AS node, 0 AS hops UNION SELECT s.dst, r.hops + 1 FROM r JOIN s ON s.src = r.node WHERE r.hops < 10)
SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node""")
def c17_reachable(spark, d):
    k = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return ledger.reachable(transitions(spark, d).withColumn("k", k).filter("k = 1"), "click")


_HOURLY = """h AS (SELECT entity, us, id, channel || ':' || ((us // 21600000000) % 4) AS node FROM e),
     t AS (SELECT src, node AS dst, (1000000 // count(*))::BIGINT AS w FROM (SELECT node, lag(node) OVER (PARTITION BY entity ORDER BY us, id) AS src FROM h) WHERE src IS NOT NULL GROUP BY ALL)"""


@query("c17_cost", f"""
WITH RECURSIVE {E}, {_HOURLY}, r(node, cost) USING KEY (node) AS (
  SELECT 'click:0', 0::BIGINT UNION
  SELECT t.dst, min(r.cost + t.w) FROM r JOIN t ON t.src = r.node LEFT JOIN recurring.r q ON q.node = t.dst WHERE q.cost IS NULL OR r.cost + t.w < q.cost GROUP BY t.dst)
SELECT node, cost FROM r""")
def c17_cost(spark, d):
    """Cheapest ways between channels in quarters of the day; a step costs the less, the oftener it is made."""
    edges = transitions(spark, d, hours=6).withColumn("w", F.expr("1000000 div w"))
    return ledger.cheapest(edges, "click:0")


@query("c17_path", f"""
WITH {E}, d AS (SELECT entity, us, id, value - lag(value) OVER (PARTITION BY entity ORDER BY us, id) AS d FROM e),
     s AS (SELECT entity, d, abs(d - lag(d) OVER (PARTITION BY entity ORDER BY us, id)) AS dd FROM d)
SELECT entity, round(coalesce(sum(abs(d)), 0), 6) AS length, round(avg(dd), 6) AS roughness FROM s GROUP BY entity""")
def c17_path(spark, d):
    return _rounded(ledger.path_length(readings(spark, d), "entity", "us", "id", "value"), "length", "roughness")


@query("c18_levels", """
WITH RECURSIVE n AS (SELECT n_nationkey AS k FROM nation), t AS (SELECT k // 2 AS src, k AS dst FROM n WHERE k > 0 UNION SELECT k // 3, k FROM n WHERE k > 0),
     r AS (SELECT 0 AS node, 0 AS level UNION SELECT t.dst, r.level + 1 FROM r JOIN t ON t.src = r.node WHERE r.level < 30)
SELECT node::VARCHAR AS node, max(level)::BIGINT AS level FROM r GROUP BY node""")
def c18_levels(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("k")).filter("k > 0")
    edges = n.selectExpr("cast(k div 2 as string) as src", "cast(k as string) as dst").unionByName(
        n.selectExpr("cast(k div 3 as string) as src", "cast(k as string) as dst")
    ).distinct()
    return ledger.levels(edges)


@query("c18_recursive", """
WITH RECURSIVE n AS (SELECT n_nationkey AS k FROM nation), t AS (SELECT k // 2 AS src, k AS dst FROM n WHERE k > 0 UNION SELECT k // 3, k FROM n WHERE k > 0),
     r AS (SELECT 0 AS node, 0 AS level UNION SELECT t.dst, r.level + 1 FROM r JOIN t ON t.src = r.node WHERE r.level < 30)
SELECT node::BIGINT AS node, max(level)::BIGINT AS level FROM r GROUP BY node""")
def c18_recursive(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = n.filter("k > 0").selectExpr("k as dst", "explode(array(k div 2, k div 3)) as src")
    return ledger.levels_sql(edges, n.filter("k = 0").select(F.col("k").alias("node")))


@query("c18_early", f"""
WITH {E}, f AS (SELECT entity, channel, min(us) AS us FROM e GROUP BY ALL), n AS (SELECT * FROM (VALUES ('purchase', 'view'), ('view', 'signup')) v(task, need))
SELECT a.entity, a.channel, n.need FROM f a JOIN n ON n.task = a.channel LEFT JOIN f b ON b.entity = a.entity AND b.channel = n.need WHERE b.us IS NULL OR b.us > a.us""")
def c18_early(spark, d):
    needs = spark.createDataFrame([("purchase", "view"), ("view", "signup")], "channel string, need string")
    return ledger.early(readings(spark, d), needs, "entity", "channel", "us")


@query("c19_tracking", f"""
WITH {E}, w AS (SELECT channel, value, avg(value) OVER (PARTITION BY entity ORDER BY us, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ref FROM e)
SELECT channel, count(*) AS n, round(sqrt(avg((value - ref) * (value - ref))), 6) AS rmse, round(max(abs(value - ref)), 6) AS max_error, round(count(*) FILTER (abs(value - ref) <= 20) / count(*), 6) AS in_band FROM w GROUP BY channel""")
def c19_tracking(spark, d):
    r = timeline.trailing_mean(readings(spark, d), "entity", "us", "id", "value", 5, "ref")
    t = evaluation.tracking(r, "channel", "ref", "value", 20.0)
    return _rounded(t, "rmse", "max_error", "in_band")


@query("c19_loop", f"""
WITH RECURSIVE {E}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us, id) AS k FROM e),
     r AS (SELECT entity, us, id, k, 0.2::DOUBLE * (0.8::DOUBLE * value + 0.1::DOUBLE * value) AS y, value AS total, value AS ref FROM o WHERE k = 1
           UNION ALL SELECT o.entity, o.us, o.id, o.k, r.y + 0.2::DOUBLE * (0.8::DOUBLE * (o.value - r.y) + 0.1::DOUBLE * (r.total + (o.value - r.y)) - r.y), r.total + (o.value - r.y), o.value FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1)
SELECT entity, us, id, round(y, 6) AS output, round(ref - y, 6) AS error FROM r""")
def c19_loop(spark, d):
    return _rounded(recursive.control_loop(readings(spark, d), "entity", ("us", "id"), "value", 0.8, 0.1, 0.2), "output", "error")


@query("c20_limits", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT vec_id, v, list_transform(v, lambda x: greatest(x - 0.2::DOUBLE, -0.2::DOUBLE - x, 0::DOUBLE)) AS e FROM v)
SELECT vec_id, len(list_filter(e, lambda x: x > 0))::BIGINT AS n_violations, round(list_max(e), 6) AS max_excess, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM x""")
def c20_limits(spark, d):
    return _rounded(evaluation.joint_limits(load(spark, d, "embeddings"), "vec_id", "embedding", -0.2, 0.2), "max_excess", "norm")


@query("c21_step", f"""
WITH {E}, f AS (SELECT *, last_value(value) OVER (PARTITION BY entity ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM e)
SELECT entity, any_value(final) AS final, round(greatest(max(value) - any_value(final), 0) / any_value(final), 6) AS overshoot,
       coalesce(max(us) FILTER (abs(value - final) > 0.5 * abs(final)) - min(us), 0) AS settling_us FROM f GROUP BY entity""")
def c21_step(spark, d):
    return _rounded(timeline.step_response(readings(spark, d), "entity", "us", "id", "value", 0.5), "overshoot")


@query("c21_tune", """
WITH g AS (SELECT p_size AS gain, l_discount AS damping, abs(l_quantity - 25) AS loss FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT gain, damping, round(avg(loss), 6) AS loss FROM g GROUP BY gain, damping ORDER BY round(avg(loss), 9), gain, damping LIMIT 1""")
def c21_tune(spark, d):
    j = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _rounded(
        evaluation.tune(
            j.select(F.col("p_size").alias("gain"), F.col("l_discount").alias("damping"), F.abs(F.col("l_quantity") - 25).alias("loss")),
            ("gain", "damping"), "loss"
        ),
        "loss"
    )


@query("c22_tokens", f"""
WITH {E}, k AS (SELECT channel, value, greatest(least(CASE WHEN value = 100 THEN 16 WHEN value < 0 THEN 0 WHEN value > 100 THEN 17 ELSE floor(value / 100.0::DOUBLE * 16)::BIGINT + 1 END, 16), 1) AS token FROM e),
     b AS (SELECT *, abs(value - (token - 0.5::DOUBLE) * 6.25::DOUBLE) AS err FROM k)
SELECT channel, count(*) AS n, count(DISTINCT token) AS n_tokens, round(avg(err), 6) AS mean_error, round(max(err), 6) AS max_error FROM b GROUP BY channel""")
def c22_tokens(spark, d):
    return _rounded(evaluation.discretise(readings(spark, d), "channel", "value", 0.0, 100.0, 16), "mean_error", "max_error")


@query("c23_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
     p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query, neighbour, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM p QUALIFY rank <= 5""")
def c23_topk(spark, d):
    v = load(spark, d, "embeddings")
    return evaluation.top_similar(v, v.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5)


@query("c23_horizon", f"""
WITH {E}, w AS (SELECT abs(value - lag(value, 1) OVER w) AS h1, abs(value - lag(value, 2) OVER w) AS h2, abs(value - lag(value, 5) OVER w) AS h5 FROM e WINDOW w AS (PARTITION BY entity ORDER BY us, id))
SELECT 'h1' AS horizon, round(avg(h1), 6) AS error FROM w UNION ALL SELECT 'h2', round(avg(h2), 6) FROM w UNION ALL SELECT 'h5', round(avg(h5), 6) FROM w""")
def c23_horizon(spark, d):
    return _rounded(evaluation.horizon_error(readings(spark, d), "entity", "us", "id", "value", (1, 2, 5)), "error")


_CHOICES = """c AS (SELECT source, lang, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 1) AS b FROM documents GROUP BY source, lang),
     p AS (SELECT source, lang, (a + 1) / (sum(a) OVER (PARTITION BY source) + 4) AS p, (b + 1) / (sum(b) OVER (PARTITION BY source) + 4) AS q FROM c)"""


def _choices(spark, d):
    """How two halves of the documents share out the languages of each source: teacher p, student q."""
    s = Window.partitionBy("source")
    even = F.col("doc_id") % 2 == 0
    c = load(spark, d, "documents").groupBy("source", "lang").agg(F.count_if(even).alias("a"), F.count_if(~even).alias("b"))
    share = lambda n: (F.col(n) + 1) / (F.sum(n).over(s) + 4)
    return c.select("source", "lang", share("a").alias("p"), share("b").alias("q"))


@query("c24_distill", f"WITH {_CHOICES} SELECT source, round(sum(CASE WHEN p = 0 THEN 0 ELSE p * ln(p / q) END), 6) AS kl FROM p GROUP BY source")
def c24_distill(spark, d):
    return _rounded(evaluation.divergence(_choices(spark, d), "source", "p", "q"), "kl")


_BOTH = f"""{_CHOICES},
     t AS (SELECT source, arg_max(lang, (p, lang)) AS teacher, max(p) AS confidence, arg_max(lang, (q, lang)) AS student FROM p GROUP BY source),
     b AS (SELECT *, teacher = student AS agrees, confidence >= 0.4 AS confident FROM t)"""


def _both(spark, d):
    return evaluation.teacher_student(_choices(spark, d), "source", "lang", "p", "q", 0.4)


@query("c24_subset", f"WITH {_BOTH} SELECT source, teacher, student, round(confidence, 6) AS confidence, agrees FROM b WHERE confident")
def c24_subset(spark, d):
    return _rounded(_both(spark, d).filter("confident").drop("confident"), "confidence")


@query("c24_agreement", f"""
WITH {_BOTH} SELECT count(*) AS n, count(*) FILTER (confident) AS n_confident, round(count(*) FILTER (agrees) / count(*), 6) AS agreement,
       round(count(*) FILTER (agrees AND confident) / nullif(count(*) FILTER (confident), 0), 6) AS confident_agreement FROM b""")
def c24_agreement(spark, d):
    return _rounded(evaluation.agreement_rate(_both(spark, d)), "agreement", "confident_agreement")


@query("c25_simulators", """
WITH s AS (SELECT p_brand AS option, avg(p_size) AS size, avg(p_retailprice) / 100 AS price, count(DISTINCT p_type)::DOUBLE AS variety FROM part GROUP BY p_brand),
     t AS (SELECT option, round((size * 0.5::DOUBLE + price * 0.3::DOUBLE + variety * 0.2::DOUBLE) / 1.0::DOUBLE, 6) AS total FROM s)
SELECT option, total, dense_rank() OVER (ORDER BY total DESC) AS rank FROM t""")
def c25_simulators(spark, d):
    s = load(spark, d, "part").groupBy(F.col("p_brand").alias("option")).agg(
        F.avg("p_size").alias("size"), (F.avg("p_retailprice") / 100).alias("price"),
        F.countDistinct("p_type").cast("double").alias("variety")
    )
    return quality.rank_weighted(s, "option", {"size": 0.5, "price": 0.3, "variety": 0.2})


@query("c26_reconcile", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing_left' WHEN b.k IS NULL THEN 'missing_right' ELSE 'differs' END AS status
FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) a FULL JOIN (SELECT c_custkey AS k, c_nationkey AS n FROM customer) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.n IS DISTINCT FROM b.n""")
def c26_reconcile(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    b = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return ledger.reconcile(a, b, "k", ("n",))


@query("c27_generate", """
SELECT id, ('0x' || substr(md5('7e:' || id), 1, 8))::BIGINT % 20 AS entity, ('0x' || substr(md5('7v:' || id), 1, 8))::BIGINT % 100000 / 1000 AS value FROM (SELECT unnest(range(5000)) AS id)""")
def c27_generate(spark, d):
    return ledger.generate(spark, 5000, 20, 7)


@query("c29_monitor", f"""
WITH {E}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us, id) AS k FROM e),
     s AS (SELECT entity, id, k, avg(value) OVER (PARTITION BY entity ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smoothed, max(value) OVER u AS best,
                  value > max(value) OVER (PARTITION BY entity ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE AS x,
                  coalesce(value > max(value) OVER (PARTITION BY entity ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
           FROM o WINDOW u AS (PARTITION BY entity ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT entity, id, round(smoothed, 6) AS smoothed, best, k - max(CASE WHEN better THEN k END) OVER (PARTITION BY entity ORDER BY k ROWS UNBOUNDED PRECEDING) AS plateau FROM s""".replace("                  value > max(value) OVER (PARTITION BY entity ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE AS x,\n", ""))
def c29_monitor(spark, d):
    r = timeline.smooth(readings(spark, d), "entity", "us", "id", "value", 5)
    return _rounded(r, "smoothed").select("entity", "id", "smoothed", "best", "plateau")


@query("c31_funnel", f"""
WITH {E}, f AS (SELECT entity, min(us) FILTER (channel = 'signup') AS t0, min(us) FILTER (channel = 'view') AS t1, min(us) FILTER (channel = 'purchase') AS t2 FROM e GROUP BY entity),
     c AS (SELECT count(*) FILTER (t0 IS NOT NULL) AS n0, count(*) FILTER (t0 IS NOT NULL AND t1 >= t0) AS n1, count(*) FILTER (t0 IS NOT NULL AND t1 >= t0 AND t2 >= t1) AS n2 FROM f)
SELECT 1::BIGINT AS step, 'signup' AS stage, n0 AS n, NULL::DOUBLE AS from_before FROM c UNION ALL SELECT 2, 'view', n1, round(n1 / n0, 6) FROM c UNION ALL SELECT 3, 'purchase', n2, round(n2 / n1, 6) FROM c""")
def c31_funnel(spark, d):
    return _rounded(timeline.funnel(readings(spark, d), "entity", "channel", "us", ("signup", "view", "purchase")), "from_before")


@query("c32_budget", """
SELECT p_brand AS category, p_type AS kind, grouping(p_brand, p_type)::BIGINT AS grouping, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS cost,
       grouping(p_brand, p_type) = 1 AND sum(l_extendedprice) > 60000000 AS over FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_type)""")
def c32_budget(spark, d):
    return ledger.budget(costs(spark, d), "category", "kind", "qty", "cost", 60_000_000).withColumn("cost", F.round("cost", 2))


@query("c33_drift", f"""
WITH {E} SELECT entity, round(regr_slope(value, us / 86400000000), 6) AS slope, round(regr_r2(value, us / 86400000000), 6) AS r2, round(corr(value, us / 86400000000), 6) AS corr,
       abs(regr_slope(value, us / 86400000000)) <= 0.2 AS ok FROM (SELECT entity, value, us - 1704067200000000 AS us FROM e) GROUP BY entity""")
def c33_drift(spark, d):
    r = evaluation.drift(readings(spark, d), "entity", (F.col("us") - 1704067200000000) / 86400000000, "value", 0.2)
    return _rounded(r, "slope", "r2", "corr")


@query("c34_ripple", f"""
WITH {E}, w AS (SELECT entity, id, value, max(value) OVER w - min(value) OVER w AS spread, stddev_samp(value) OVER w AS sd, avg(value) OVER w AS m FROM e WINDOW w AS (PARTITION BY entity ORDER BY us, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT entity, id, round(spread, 6) AS spread, round(sd, 6) AS sd, coalesce(abs(value - m) > 2.5::DOUBLE * sd, false) AS spike FROM w""")
def c34_ripple(spark, d):
    r = timeline.ripple(readings(spark, d), "entity", "us", "id", "value", 10, 2.5)
    return _rounded(r, "spread", "sd").select("entity", "id", "spread", "sd", "spike")


@query("c35_jitter", f"""
WITH {E}, d AS (SELECT entity, us - lag(us) OVER (PARTITION BY entity ORDER BY us, id) AS d FROM e)
SELECT entity, count(*) AS n, round(avg(d), 0) AS mean, round(stddev_samp(d), 0) AS jitter, quantile_cont(d, 0.5)::DOUBLE AS median FROM d WHERE d IS NOT NULL GROUP BY entity""")
def c35_jitter(spark, d):
    return timeline.jitter(readings(spark, d), "entity", "us", "id").withColumns({"mean": F.round("mean", 0), "jitter": F.round("jitter", 0)})


@query("c35_gaps", f"""
WITH {E}, d AS (SELECT entity, lag(us) OVER w AS from_us, us - lag(us) OVER w AS length FROM e WINDOW w AS (PARTITION BY entity ORDER BY us, id))
SELECT entity, from_us, length FROM d WHERE length > 43200000000""")
def c35_gaps(spark, d):
    return timeline.gaps(readings(spark, d), "entity", "us", "id", 12 * H)


@query("c36_calibrate", """
SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS scale, round(regr_intercept(l_extendedprice, l_quantity), 3) AS "offset",
       round(sqrt(greatest(regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity), 0) / count(*)), 3) AS residual FROM lineitem GROUP BY l_returnflag""")
def c36_calibrate(spark, d):
    f = evaluation.fit_linear(load(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return f.withColumns({"scale": r6(F.col("scale")), "offset": F.round("offset", 3), "residual": F.round("residual", 3)})


@query("c36_robust", """
WITH c AS (SELECT l_returnflag, least(floor((l_quantity - 0.5::DOUBLE) / 2.0::DOUBLE), 24)::BIGINT AS a, least(floor(l_extendedprice / 250.0::DOUBLE), 511)::BIGINT AS b
           FROM lineitem WHERE l_quantity BETWEEN 0.5 AND 50.5 AND l_extendedprice BETWEEN 0 AND 128000),
     k AS (SELECT l_returnflag, a, b, row_number() OVER (PARTITION BY l_returnflag, a ORDER BY b) AS k, count(*) OVER (PARTITION BY l_returnflag, a) AS n FROM c),
     m AS (SELECT l_returnflag, 0.5::DOUBLE + (a + 0.5::DOUBLE) * 2 AS x, (b + 0.5::DOUBLE) * 250 AS y FROM k WHERE k = (n + 1) // 2),
     s AS (SELECT p.l_returnflag, quantile_cont((q.y - p.y) / (q.x - p.x), 0.5) AS scale FROM m p JOIN m q ON p.l_returnflag = q.l_returnflag AND p.x < q.x GROUP BY p.l_returnflag)
SELECT l_returnflag, (SELECT count(*) FROM c WHERE c.l_returnflag = s.l_returnflag) AS n, round(scale, 6) AS scale, round((SELECT quantile_cont(y - scale * x, 0.5) FROM m WHERE m.l_returnflag = s.l_returnflag), 3) AS "offset" FROM s""")
def c36_robust(spark, d):
    f = mergeable.robust_line(load(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", (0.5, 50.5), (0.0, 128_000.0), 25)
    return f.withColumns({"scale": r6(F.col("scale")), "offset": F.round("offset", 3)})


@query("c36_mtbf", f"""
WITH {E}, d AS (SELECT entity, us - lag(us) OVER (PARTITION BY entity ORDER BY us, id) AS d FROM e WHERE channel = 'error')
SELECT entity, count(*) AS n_failures, round(avg(d) / 3600000000, 6) AS mtbf_hours FROM d GROUP BY entity""")
def c36_mtbf(spark, d):
    return _rounded(timeline.between_failures(readings(spark, d).filter("channel = 'error'"), "entity", "us"), "mtbf_hours")


@query("c37_deadline", f"""
WITH {E}, d AS (SELECT entity, us - lag(us) OVER (PARTITION BY entity ORDER BY us, id) AS d FROM e)
SELECT entity, count(*) AS n, count(*) FILTER (d > 36000000000) AS n_miss, round(count(*) FILTER (d > 36000000000) / count(*), 6) AS miss_ratio, round(quantile_cont(d::DOUBLE, 0.99), 0) AS p99 FROM d WHERE d IS NOT NULL GROUP BY entity""")
def c37_deadline(spark, d):
    return _rounded(timeline.deadline_miss(readings(spark, d), "entity", "us", "id", 10 * H), "miss_ratio").withColumn("p99", F.round("p99", 0))


@query("c38_latency", f"""
WITH {E} SELECT (us // 3600000000) * 3600000000 AS bucket, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM e GROUP BY bucket""")
def c38_latency(spark, d):
    return _rounded(timeline.throughput(readings(spark, d), "us", "value", H), "p50", "p95")


@query("c39_quantise", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM v),
     e AS (SELECT vec_id, scale, list_transform(v, lambda x: abs(x - floor(x / scale + 0.5::DOUBLE) * scale)) AS e FROM s)
SELECT vec_id, round(scale, 6) AS scale, round(list_max(e), 6) AS max_error, round(list_sum(e) / len(e), 6) AS mean_error FROM e""")
def c39_quantise(spark, d):
    return _rounded(evaluation.quantise(load(spark, d, "embeddings"), "vec_id", "embedding", 8), "scale", "max_error", "mean_error")


_STAGES = ("click", "error", "purchase", "signup", "view")


@query("c40_stages", f"""
WITH {E}, s AS (SELECT entity, channel, lead(us) OVER (PARTITION BY entity ORDER BY us, id) - us AS d FROM e),
     p AS (SELECT entity, {', '.join(f"coalesce(sum(d) FILTER (channel = '{s}'), 0) AS {s}" for s in _STAGES)} FROM s WHERE d IS NOT NULL GROUP BY entity)
SELECT entity, {', '.join(f"round({s} / ({' + '.join(_STAGES)}), 6) AS share_{s}" for s in _STAGES)},
       list_reverse_sort([{', '.join(f"{{'d': {s}, 's': '{s}'}}" for s in _STAGES)}])[1].s AS dominant FROM p""")
def c40_stages(spark, d):
    return _rounded(timeline.stage_shares(readings(spark, d), "entity", "channel", "us", "id", _STAGES), *[f"share_{s}" for s in _STAGES])
