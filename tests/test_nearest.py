"""The most similar vectors against SQL over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from robolake.operators import nearest


def same_as_sql(spark, tmp_path, rows, most=10_000, k=5, kind="float"):
    from compare import connect

    from robolake.plans import robots

    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    path = str(tmp_path / "embeddings.parquet")
    df.repartition(3).write.mode("overwrite").parquet(path)
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    told = lambda rs: sorted(repr(tuple(r)) for r in rs)
    want = con.sql(robots.SQL["c23_topk"].replace("rank <= 5", f"rank <= {k}")).fetchall()
    v = spark.read.parquet(path)
    got = nearest.top_similar(v, v.filter("vec_id % 20 = 0"), "vec_id", "embedding", k, most).collect()
    assert told(got) == told(want)
    return got


@pytest.mark.parametrize("most", [10_000, 7])
@pytest.mark.parametrize("values", [1 << 20, 300])
def test_blocks(spark, tmp_path, monkeypatch, values, most):
    """Copies in large groups, near copies, zeros, and vectors that aren't numbers, in one block and in many."""
    monkeypatch.setattr(nearest, "VALUES", values)
    monkeypatch.setattr(nearest, "RANGES", 8)
    monkeypatch.setattr(nearest, "PAIRS", 2000)
    rnd = random.Random(values)
    base = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(900):
        v = list(rnd.choice(base)) if i % 3 else [rnd.gauss(0, 1) for _ in range(6)]
        if i % 5 == 0:
            v[rnd.randrange(6)] += rnd.choice((1e-7, 1e-3, 0.1))
        rows.append((i * 7 % 1800, v))
    same_as_sql(spark, tmp_path, rows, most)
    rows += [(2000, [0.0] * 6), (2001, [0.0] * 6), (2020, [float("inf")] + [1.0] * 5), (2003, [float("nan")] * 6), (2040, [1e-30] * 6), (2005, [1e30] * 6)]
    got = same_as_sql(spark, tmp_path, rows, most, 3)
    assert {r["neighbour"] for r in got if r["query"] == 0} == {2000, 2001, 2003}


def test_doubles_of_any_length_and_few_rows(spark, tmp_path):
    rows = [(0, [1e-170, 0.0]), (20, [1e-170, 1e-170]), (40, [1e200, 1.0]), (1, [3.0, 4.0]), (2, [-3.0, -4.0]), (3, [1e150, 1e-150])]
    same_as_sql(spark, tmp_path, rows, kind="double")
    assert nearest.top_similar(*[spark.createDataFrame([], "vec_id long, embedding array<double>")] * 2, "vec_id", "embedding", 5).count() == 0


def test_vectors_that_cannot_be_compared_come_last(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [1.0]), ("e", [0.5, 0.5]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "k string, v array<double>")
    got = nearest.top_similar(v, v.filter("k in ('a', 'b')"), "k", "v", 3).orderBy("query", "rank").collect()
    want = [("a", "e", 0.707107, 1), ("a", "b", None, 2), ("a", "c", None, 3), ("b", "a", None, 1), ("b", "c", None, 2), ("b", "d", None, 3)]
    assert [tuple(r) for r in got] == want


def test_time_grows_with_products_not_with_lambdas(spark):
    """2,000 queries against 40,000 vectors; one call of a lambda for each component of a pair takes minutes."""
    v = spark.range(40_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.xxhash64("id", i) % 1000).cast("float")).alias("e"))
    got = nearest.top_similar(v, v.filter("vec_id % 20 = 0"), "vec_id", "e", 5)
    assert got.count() == 10_000 and got.filter("rank = 1 and cosine < 0.3").count() == 0
