"""Queries over the parts of the DataFrame and SQL surface that no capability above uses: sources, grouping sets, rankings, frames, sets, functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from robolake.functions.columns import micros, r6
from robolake.functions.scratch import shared_folder
from robolake.operators import evaluation, timeline
from robolake.sources.tables import load, read_rows

DAY = 24 * 3600 * timeline.SECOND
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_NATION = "n_nationkey int, n_name string, n_regionkey int"


def _through_file(spark, d, fmt):
    """nation written in a format and read again by an explicit schema."""
    path = shared_folder(spark, fmt)
    writer = load(spark, d, "nation").write
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
    return read_rows(spark, path, fmt, _NATION)


@query("src_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_json(spark, d):
    return _through_file(spark, d, "json")


@query("src_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark, d):
    return _through_file(spark, d, "csv")


@query("src_range", "SELECT unnest(range(100)) AS id")
def src_range(spark, d):
    return spark.range(100)


@query("snk_memory", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def snk_memory(spark, d):
    """Counts of a stream, kept complete in a table in memory: for looks at a running job, one row a kind of event."""
    from robolake.streaming import jobs

    name = shared_folder(spark, "m").rsplit("/", 1)[1].replace("-", "_")
    counts = jobs.events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option(
        "checkpointLocation", shared_folder(spark, "memory")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("agg_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS grouping, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())""")
def agg_grouping_sets(spark, d):
    o = load(spark, d, "orders")
    sets = [[F.col("o_orderstatus"), F.col("o_orderpriority")], [F.col("o_orderpriority")], []]
    sums = [F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")]
    return o.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(*sums)


@query("agg_distinct", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, true AS close FROM lineitem GROUP BY l_returnflag""")
def agg_distinct(spark, d):
    """Exact and sketched distinct counts of some thousands of values; close tells whether the sketch, made for an error of 2 %, is within 8 %."""
    lines = load(spark, d, "lineitem")
    exact, near = F.countDistinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
    return lines.groupBy("l_returnflag").agg(exact.alias("n_parts"), (F.abs(near - exact) <= exact * 0.08).alias("close"))


@query("agg_first_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def agg_first_rows(spark, d):
    return load(spark, d, "customer").dropDuplicates(["c_nationkey", "c_mktsegment"]).select("c_nationkey", "c_mktsegment")


@query("win_ranks", """
SELECT p_partkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS share, round(cume_dist() OVER w, 6) AS upto, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rank,
       nth_value(p_partkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""")
def win_ranks(spark, d):
    """The rankings of a window over brands, however many parts a brand has."""
    r = evaluation.ranks(load(spark, d, "part"), "p_brand", "p_size", "p_partkey", 4, 2)
    return r.select("p_partkey", F.col("part").alias("quarter"), r6(F.col("share")).alias("share"), r6(F.col("upto")).alias("upto"), "rank", F.col("nth").alias("second"))


@query("win_rows", """
SELECT p_partkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS share, rank() OVER (PARTITION BY p_brand, p_type ORDER BY p_size) AS rank
FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey)""")
def win_rows(spark, d):
    """Rankings by plain windows, for keys of few rows."""
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_size", "p_partkey")
    place = F.rank().over(Window.partitionBy("p_brand", "p_type").orderBy("p_size")).cast("long").alias("rank")
    return load(spark, d, "part").select("p_partkey", F.ntile(4).over(w).cast("long").alias("quarter"), r6(F.percent_rank().over(w)).alias("share"), place)


@query("win_range", """
SELECT o_orderkey, count(*) OVER w AS n_week, round(sum(o_totalprice) OVER w, 2) AS week_total
FROM (SELECT *, epoch_us(o_orderdate) AS us FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)""")
def win_range(spark, d):
    """Orders of a customer in the week before each; a range of time, not of rows."""
    o = load(spark, d, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    w = Window.partitionBy("o_custkey").orderBy("us").rangeBetween(-604_800_000_000, 0)
    return o.select("o_orderkey", F.count(F.lit(1)).over(w).alias("n_week"), F.round(F.sum("o_totalprice").over(w), 2).alias("week_total"))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(spark, d, "supplier").select("s_nationkey"))


@query("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(load(spark, d, "supplier").select("s_nationkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_except(spark, d):
    """Customers without a large order."""
    large = load(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey")
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(large)


@query("fn_strings", """
SELECT p_partkey, levenshtein(p_brand, 'Brand#13') AS distance, regexp_replace(regexp_replace(regexp_replace(p_brand, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS masked,
       concat_ws('/', p_brand, p_type) AS path, string_split(p_type, ' ')[1] AS word FROM part""")
def fn_strings(spark, d):
    p = load(spark, d, "part")
    distance = F.levenshtein("p_brand", F.lit("Brand#13")).cast("long").alias("distance")
    return p.select(
        "p_partkey", distance, F.mask("p_brand").alias("masked"), F.concat_ws("/", "p_brand", "p_type").alias("path"),
        F.split("p_type", " ")[0].alias("word")
    )


@query("fn_dates", """
SELECT epoch_us(date_trunc('month', o_orderdate)) AS month, count(*) AS n, max(date_diff('day', date_trunc('month', o_orderdate), o_orderdate)) AS last_day FROM orders GROUP BY 1""")
def fn_dates(spark, d):
    o = load(spark, d, "orders").withColumn("m", F.date_trunc("month", "o_orderdate"))
    month = F.unix_micros(F.col("m").cast("timestamp")).alias("month")
    return o.groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.max(F.datediff("o_orderdate", "m")).cast("long").alias("last_day"))


@query("fn_json", """
SELECT event_id, (props->>'$.k')::BIGINT AS k, 'STRUCT<k: BIGINT>' AS kind, (props->>'$.k')::BIGINT AS from_map FROM events""")
def fn_json(spark, d):
    """A field of a JSON text by path, its schema, and the same by a map of entries."""
    e = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    pairs = F.map_from_entries(F.array(F.struct(F.lit("k").alias("key"), k.alias("value"))))
    return e.select("event_id", k.alias("k"), F.schema_of_json(F.lit('{"k": 1}')).alias("kind"), F.element_at(pairs, "k").alias("from_map"))


@query("fn_recursive", """
WITH RECURSIVE r AS (SELECT 0 AS n, 1::BIGINT AS value UNION ALL SELECT n + 1, value * 2 FROM r WHERE n < 20) SELECT n, value FROM r""")
def fn_recursive(spark, d):
    return spark.sql("WITH RECURSIVE r (n, value) AS (SELECT 0, 1L UNION ALL SELECT n + 1, value * 2 FROM r WHERE n < 20) SELECT n, value FROM r")


@query("udf_pandas", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS l1 FROM embeddings")
def udf_pandas(spark, d):
    """A user's own column function over Arrow batches."""

    @F.pandas_udf("double")
    def l1(v: pd.Series) -> pd.Series:
        sizes = v.map(len).to_numpy()
        flat = np.abs(np.concatenate([*v, np.zeros(0)]).astype("float64"))
        return pd.Series(np.diff(np.concatenate([[0.0], np.cumsum(flat)])[np.concatenate([[0], np.cumsum(sizes)])]))

    return load(spark, d, "embeddings").select("vec_id", F.round(l1("embedding"), 4).alias("l1"))


@query("udf_arrow", "SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE), 'median'), 6) AS middle FROM embeddings")
def udf_arrow(spark, d):
    """The median of a vector's elements, which no function over arrays gives, on Arrow arrays."""

    @F.arrow_udf("double")
    def middle(v: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype("float64")
        rows = np.repeat(np.arange(len(size)), size)
        flat, end = flat[np.lexsort((flat, rows))], np.cumsum(size)
        at = lambda k: flat[np.clip(end - size + k, 0, max(0, len(flat) - 1))] if len(flat) else np.zeros(len(size))
        return pa.array((at((size - 1) // 2) + at(size // 2)) / 2, mask=size == 0)

    return load(spark, d, "embeddings").select("vec_id", F.round(middle("embedding"), 6).alias("middle"))


@query("udf_frames", "SELECT event_type, sum(value > 50)::BIGINT AS n FROM events GROUP BY event_type")
def udf_frames(spark, d):
    """A user's own step over frames of rows, summed up by Spark."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(high=(f["value"] > 50).astype("int64"))[["event_type", "high"]]

    rows = load(spark, d, "events").select("event_type", "value").mapInPandas(step, "event_type string, high long")
    return rows.groupBy("event_type").agg(F.sum("high").alias("n"))


@query("udf_table", "SELECT r_regionkey, unnest(range(1, r_regionkey + 2))::INT AS n FROM region")
def udf_table(spark, d):
    """A user's own table function, called for each row."""

    @F.udtf(returnType="n int")
    class Upto:
        def eval(self, last: int):
            for n in range(1, last + 1):
                yield (n,)

    spark.udtf.register("upto_number", Upto)
    load(spark, d, "region").createOrReplaceTempView("surface_region")
    return spark.sql("SELECT r_regionkey, n FROM surface_region, LATERAL upto_number(r_regionkey + 1)")


@query("join_theta", """
SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def join_theta(spark, d):
    n = load(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("low")), n.select("n_regionkey", F.col("n_nationkey").alias("high"))
    return a.join(b, "n_regionkey").filter("low < high").select("low", "high")


@query("join_band", f"""
WITH o AS (SELECT o_orderkey, 1704067200000000 + epoch_us(o_orderdate) % {30 * DAY} + o_orderkey % {DAY} AS t0 FROM orders), e AS (SELECT event_id, epoch_us(ts) AS us FROM events)
SELECT o_orderkey, event_id FROM o JOIN e ON us BETWEEN t0 - 20000000 AND t0 + 40000000""")
def join_band(spark, d):
    """Orders, their dates laid into the month of the events, against events from 20 seconds before to 40 after: no key is equal."""
    at = F.lit(1704067200000000) + micros("o_orderdate") % (30 * DAY) + F.col("o_orderkey") % DAY
    orders = load(spark, d, "orders").select("o_orderkey", at.alias("at"))
    events = load(spark, d, "events").select("event_id", micros("ts").alias("us"))
    return timeline.band_join(orders, events, "at", "us", 20 * timeline.SECOND, 40 * timeline.SECOND).select("o_orderkey", "event_id")


@query("join_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def join_semi(spark, d):
    lines = load(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return load(spark, d, "supplier").join(lines, "s_suppkey", "left_semi").select("s_suppkey")


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
