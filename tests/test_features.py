"""Comparisons, matching, paths, band joins, observed stages and user aggregates against plain Python, and what plans must not have."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from robolake.functions import mergeable
from robolake.operators import evaluation, ledger, quality, release, timeline


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_replay_tells_bars_and_nulls_apart(spark):
    schema = "k long, x string, y string, z double"
    a = spark.createDataFrame([(1, None, "a|b", 1.0), (2, "p", "q", 2.0), (2, "p", "q", 2.0), (3, "s", None, 1.0), (None, "n", "n", 0.0), (5, "only", "a", 1.0)], schema)
    b = spark.createDataFrame([(1, "-", "a", 1.0), (2, "p", "q", 2.0), (3, "s", None, 1.0), (None, "n", "n", 0.0), (2, "p", "q", 2.0), (6, "only", "b", 1.0)], schema)
    want = [(1, 1, 1, False), (2, 2, 2, True), (3, 1, 1, True), (None, 1, 1, True), (5, 1, 0, False), (6, 0, 1, False)]
    assert rows(release.replay_keys(a, b, "k", ("x", "y", "z")), "k", "n_a", "n_b", "same") == sorted(want, key=str)
    assert release.replay_keys(a.limit(0), b.limit(0), "k", ("x",)).count() == 0


def test_evidence_differs_where_rows_do(spark):
    def chain(*row, columns=("a", "b", "value")):
        df = spark.createDataFrame([(1, 1, *row)], "e long, o long, a string, b string, value double")
        return release.evidence(df, "e", columns, "o").first()["chain"]

    seen = {chain(*r) for r in (("a|b", "c", 1.0), ("a", "b|c", 1.0), ("a", None, 1.0), ("a", "", 1.0), (None, "a", 1.0), ("1:a", "", 1.0), ("a", "", 1.5), ("-", None, 1.0), (None, "-", 1.0))}
    assert len(seen) == 9
    assert chain("a", "b", 1.0, columns=("a", "b")) == chain("a", "b", 2.0, columns=("a", "b"))


def boxes(rng, n, first, images=3):
    out = []
    for i in range(n):
        size = 2 ** rng.uniform(-3, 7)
        w, h = size, size * rng.uniform(0.4, 1)
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        out.append((first + i, rng.randrange(images), x, y, x + w, y + h, round(rng.random(), 1)))
    return out


def iou(a, b):
    w = min(a[4], b[4]) - max(a[2], b[2])
    h = min(a[5], b[5]) - max(a[3], b[3])
    inter = max(w, 0) * max(h, 0)
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return inter / (area(a) + area(b) - inter)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.9])
def test_boxes_are_matched_one_to_one(spark, least):
    rng = random.Random(9)
    truth = boxes(rng, 120, 0)
    pred = [(1000 + i, b[1], *(v + rng.uniform(-0.05, 0.05) * (b[4] - b[2]) for v in b[2:6]), round(rng.random(), 1)) for i, b in enumerate(rng.choices(truth, k=300))]
    pred += [(5000, 0, 1.0, 1.0, 1.0, 5.0, 0.5), (5001, 0, None, 1.0, 2.0, 2.0, 0.5)] + boxes(rng, 50, 6000)
    schema = "id long, image long, x0 double, y0 double, x1 double, y1 double, conf double"
    p, t = spark.createDataFrame(pred, schema), spark.createDataFrame(truth, schema)
    solid = [r for r in pred if r[2] is not None and r[4] > r[2]]
    near = {(a[0], b[0]): iou(a, b) for a in solid for b in truth if a[1] == b[1] and iou(a, b) >= least}
    pairs = evaluation.overlaps(p, t, "image", least)
    got = {(r["id"], r["tid"]): r["o"] for r in pairs.collect()}
    assert got.keys() == near.keys() and pairs.count() == len(near)
    free, want = {b[0] for b in truth}, set()
    for a in sorted(solid, key=lambda r: (-r[6], r[0])):
        best = max((b for b in free if (a[0], b) in near), key=lambda b: (near[a[0], b], -b), default=None)
        if best is not None:
            free.remove(best)
            want.add((a[0], best))
    assert set(rows(evaluation.matched(pairs), "id", "tid")) == want
    told = evaluation.detections(p, t, "image", least).first()
    assert (told["tp"], told["n_pred"], told["n_truth"]) == (len(want), len(pred), len(truth))
    assert evaluation.detections(p.limit(0), t, "image", least).first()["recall"] == 0


def test_far_boxes_of_an_image_don_t_meet(spark):
    """Two thousand boxes on one image, each with one neighbour: rows that meet are near the pairs that overlap."""
    schema = "id long, image long, x0 double, y0 double, x1 double, y1 double, conf double"
    df = spark.createDataFrame([(i, 0, 3.0 * i, 0.0, 3.0 * i + 1, 1.0, 0.5) for i in range(2000)], schema)
    cells = evaluation._touched(evaluation._boxes(df, "image"), F.col("__level"))
    met = cells.alias("a").join(cells.alias("b"), ["image", "__grid", "__cx", "__cy"])
    assert met.count() < 20_000 and evaluation.overlaps(df, df, "image", 0.5).count() == 2000


def test_cheapest_paths(spark):
    rng = random.Random(2)
    edges = [(str(rng.randrange(40)), str(rng.randrange(40)), rng.choice((0, 1, 5, 40, 300))) for _ in range(160)]
    best, heap, out = {"0": 0}, [(0, "0")], {}
    for s, d, w in edges:
        out.setdefault(s, []).append((d, w))
    while heap:
        c, n = heapq.heappop(heap)
        for d, w in out.get(n, []) if c == best[n] else []:
            if c + w < best.get(d, 1 << 60):
                best[d] = c + w
                heapq.heappush(heap, (c + w, d))
    df = spark.createDataFrame(edges, "src string, dst string, w long")
    for delta in (None, 7.0, 1e9):
        assert dict(rows(ledger.cheapest(df, "0", delta), "node", "cost")) == best
    assert rows(ledger.cheapest(df.limit(0), "x"), "node", "cost") == [("x", 0)]
    with pytest.raises(ValueError, match="negative"):
        ledger.cheapest(spark.createDataFrame([("a", "b", -1)], "src string, dst string, w long"), "a")


def test_recursive_levels_and_their_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(0, 5)], "src long, dst long")
    root = spark.createDataFrame([(0,)], "node long")
    assert rows(ledger.levels_sql(chain, root), "node", "level") == sorted(((i, i) for i in range(21)), key=str)
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        ledger.levels_sql(spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"), root).collect()


@pytest.mark.parametrize(("before", "after"), [(0, 0), (10, 25), (100, 0), (0, 1000)])
def test_band_join(spark, before, after):
    rng = random.Random(before + after)
    left = [(i, rng.randrange(-500, 500)) for i in range(150)] + [(999, None)]
    right = [(i, rng.randrange(-500, 500)) for i in range(150)] + [(999, None)]
    a, b = spark.createDataFrame(left, "a long, s long"), spark.createDataFrame(right, "b long, t long")
    got = timeline.band_join(a, b, "s", "t", before, after)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert rows(got, "a", "b") == sorted(((i, j) for i, s in left for j, t in right if s is not None and t is not None and s - before <= t <= s + after), key=str)


def test_stages_are_counted_while_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "b", None), (4, "c", 50), (5, "d", 6)], "id long, s string, n long")
    told = quality.staged(df, [("text", F.col("s").isNotNull()), ("few", F.col("n") < 10)], str(tmp_path / "out"))
    assert told == [("text", 5, 4, 1), ("few", 4, 2, 2)]
    assert rows(spark.read.parquet(str(tmp_path / "out")), "stage", "id") == sorted([("kept", 1), ("kept", 5), ("text", 2), ("few", 3), ("few", 4)], key=str)
    assert quality.staged(df.limit(0), [("text", F.col("s").isNotNull())], str(tmp_path / "none")) == [("text", 0, 0, 0)]


def test_type_violations(spark):
    df = spark.createDataFrame([("1", "x"), ("2.5", None), (None, "3"), ("300", "4")], "a string, b string")
    got = release.type_violations(df, {"a": (F.col("a"), "tinyint"), "b": (F.col("b"), "int")})
    assert rows(got, "rule", "n_values", "n_violations") == [("a", 3, 2), ("b", 3, 1)]


def test_robust_line(spark):
    rng = np.random.default_rng(1)
    data = []
    for g, (scale, offset) in {"up": (2.0, 10.0), "down": (-1.0, 90.0)}.items():
        x = rng.uniform(0, 40, 4000)
        y = scale * x + offset + rng.normal(0, 1, 4000)
        y[:1000] = rng.uniform(0, 100, 1000)  # a quarter of the readings is wrong
        data += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    data += [("one", 1.0, 2.0), ("none", None, 1.0), (None, 0.0, 0.0), (None, 40.0, 80.0), ("out", -5.0, 1e9)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(6)
    got = {r["g"]: r for r in mergeable.robust_line(df, "g", "x", "y", (0.0, 40.0), (0.0, 100.0), 20, 1000).collect()}
    assert abs(got["up"]["scale"] - 2) < 0.06 and abs(got["up"]["offset"] - 10) < 1 and abs(got["down"]["scale"] + 1) < 0.06
    assert (got["one"]["n"], got["one"]["scale"], got["none"]["n"], got["out"]["n"], got[None]["n"]) == (1, None, 0, 0, 2)
    assert round(got[None]["scale"], 6) == round((80.05 - 0.05) / 38, 6)
    many = spark.range(3000).selectExpr("id % 300 as g", "double(id div 300) as x", "double(2 * (id div 300)) as y")
    lines = mergeable.robust_line(many, "g", "x", "y", (-0.5, 9.5), (-0.5, 19.5), 10, 20).collect()
    assert len(lines) == 300 and all((r["n"], r["scale"]) == (10, 2.0) for r in lines)
    assert mergeable.robust_line(many.limit(0), "g", "x", "y", (0.0, 1.0), (0.0, 1.0)).count() == 0


def test_windows_without_hot_keys_are_plain(spark):
    df = spark.range(100).selectExpr("id % 5 as k", "id as us", "id as tie")
    got = timeline.tickets(df, "k", "us", "tie", 3)
    assert plan(got).count("Exchange") == 1 and "Join" not in plan(got)
    assert rows(got, "k", "ticket", "n_events") == rows(timeline.tickets(df, "k", "us", "tie", 3, hot=7), "k", "ticket", "n_events")


@pytest.mark.parametrize("large", [0, ledger.LARGE])
def test_clusters_with_a_hub_and_a_long_chain(spark, large):
    rng = random.Random(3)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = ledger.clusters(spark.createDataFrame(links, "u long, v long").repartition(3), large)
    assert rows(got, "node", "cluster") == sorted(((x, root(x)) for x in list(up)), key=str)
    assert ledger.clusters(spark.createDataFrame([], "u long, v long"), large).count() == 0
