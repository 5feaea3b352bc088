"""Prefix products against walking row by row, with keys that fill several slices."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from robolake.operators import recursive


def filtered(values, q, r):
    x, p, out = None, 0.0, []
    for z in values:
        if x is None:
            x, p = (None, 0.0) if z is None else (z, r)
        else:
            p += q
            if z is not None:
                g = p / (p + r)
                x, p = x + g * (z - x), (1 - g) * p
        out.append((x, p))
    return out


def looped(values, kp, ki, lag):
    y, total, out = 0.0, 0.0, []
    for ref in values:
        if ref is not None:
            e = ref - y
            total += e
            y += lag * (kp * e + ki * total - y)
        out.append((y, None if ref is None else ref - y))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    keys = {"hot": 3000, "one": 1, "two": 2, "gaps": 200, None: 50, "none": 20, "late": 40}
    rows = []
    for k, n in keys.items():
        for t in range(n):
            missing = k == "none" or k == "late" and t < 30 or k == "gaps" and rng.random() < 0.7 or rng.random() < 0.05
            rows.append((k, t // 3, t % 3, None if missing else rng.uniform(-50, 50)))
    df = spark.createDataFrame(rows, "k string, t long, id long, v double").repartition(6)
    return df, {k: [r[3] for r in rows if r[0] == k] for k in keys}


def same(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.fixture
def many(spark):
    """Small ranges aren't put together, so that keys of these tests fill several slices."""
    names = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("process", "noise"), [(1.0, 25.0), (0.0, 4.0), (1e-6, 1e6), (50.0, 1e-3)])
def test_filter(spark, data, process, noise, many):
    df, by = data
    got = recursive.kalman(df, "k", ("t", "id"), "v", process, noise).collect()
    assert len(got) == sum(map(len, by.values()))
    for r in got:
        want = filtered(by[r["k"]], process, noise)[3 * r["t"] + r["id"]]
        assert same(r["estimate"], want[0]) and same(r["variance"], want[1]), (r, want)


@pytest.mark.parametrize(("kp", "ki", "lag"), [(0.8, 0.1, 0.2), (1.5, 0.0, 0.5), (0.0, 0.3, 1.0)])
def test_loop(spark, data, kp, ki, lag, many):
    df, by = data
    for r in recursive.control_loop(df, "k", ("t", "id"), "v", kp, ki, lag).collect():
        want = looped(by[r["k"]], kp, ki, lag)[3 * r["t"] + r["id"]]
        assert same(r["output"], want[0]) and same(r["error"], want[1]), (r, want)


def test_no_python_worker_and_a_key_in_many_tasks(spark, data, many, monkeypatch):
    from robolake.functions import scans

    plans, written = [], scans.Rounds.written

    def spy(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(self, df)

    monkeypatch.setattr(scans.Rounds, "written", spy)
    df, _ = data
    recursive.kalman(df, "k", ("t", "id"), "v", 1.0, 25.0)
    assert plans and not any("Python" in p or "Pandas" in p or "Arrow" in p for p in plans)
    scan = scans.Scan(df, "k", ("t", "id"), scans.Rounds(spark))
    assert scan.rows.filter("k = 'hot'").select(F.countDistinct(scans.SLICE)).first()[0] > 1 and scan.most > 1


def test_one_slice_and_none(spark, data):
    df, by = data
    got = recursive.kalman(df.filter("k = 'gaps'"), "k", ("t", "id"), "v", 1.0, 25.0).collect()
    want = filtered(by["gaps"], 1.0, 25.0)
    assert all(same(r["estimate"], want[3 * r["t"] + r["id"]][0]) for r in got) and len(got) == 200
    assert recursive.kalman(df.limit(0), "k", ("t", "id"), "v", 1.0, 25.0).count() == 0


def test_ranks_over_many_slices(spark, many):
    """Places of rows in groups that fill several slices, with ties, null groups and values, and groups smaller than the number of parts."""
    from robolake.operators import evaluation

    rng = random.Random(6)
    data = [("big", rng.randrange(40)) for _ in range(900)] + [("few", 3), ("few", 3), (None, 1), (None, None), (None, 1), ("one", None)]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, v long, id long").repartition(5)
    got = {r["id"]: (r["part"], r["share"], r["upto"], r["rank"], r["nth"]) for r in evaluation.ranks(df, "g", "v", "id", 4, 2).collect()}
    groups: dict = {}
    for i, (g, v) in enumerate(data):
        groups.setdefault(g, []).append((v is not None, v or 0, i))
    for members in groups.values():
        members.sort()
        n = len(members)
        size, more = divmod(n, 4)
        parts = [k + 1 for k in range(4) for _ in range(size + (k < more))]
        for k, (there, v, i) in enumerate(members):
            rank = 1 + sum(m[:2] < (there, v) for m in members)
            nth = members[1][2] if n > 1 else None
            assert got[i] == (parts[k], k / (n - 1) if n > 1 else 0.0, (k + 1) / n, rank, nth)
    assert evaluation.ranks(df.limit(0), "g", "v", "id", 4, 2).count() == 0
