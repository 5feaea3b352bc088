"""K-means with bounds against plain integer k-means, and the edges that its docstring names."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from robolake.llm import centroids, registry
from robolake.llm.centroids import Centroids, k_means, squares

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, id int, v string"


def plain(rows, k, rounds, scale=256, salt="2:"):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows]
    named = [(hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    at = [v for _, v in sorted(named)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(at)), key=lambda c: (far(v, at[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        at = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else at[c] for c in range(len(at))]
    return sorted(((i is None, i or 0, nearest(v), far(v, at[nearest(v)])) for i, v in kept)), at


def told(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize(("k", "rounds", "spread"), [(5, 4, 1.0), (7, 5, 0.02), (1, 2, 1.0), (3, 0, 1.0), (500, 2, 1.0)])
def test_equals_plain(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    middle = rng.normal(size=(6, 8))
    v = (middle[rng.integers(0, 6, 300)] + spread * rng.normal(size=(300, 8))).round(2)
    rows = [(int(i % 290), v[i].tolist()) for i in range(300)] + [(None, v[0].tolist()), (7, v[7].tolist())]
    df = spark.createDataFrame([(i, x, 0, "c", 1, "v") for i, x in rows], SCHEMA).repartition(5)
    got, at = k_means(df, k, rounds, dims=8)
    want, centres = plain(rows, k, rounds)
    assert told(got) == want and at.tolist() == centres


def test_drops_odd_vectors_and_takes_empty_tables(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 0.0, 0.0]), (9, [-0.001, 0.5])]
    df = spark.createDataFrame([(i, x, 0, "c", 1, "v") for i, x in rows], SCHEMA)
    got, at = k_means(df, 4, 3, dims=2)
    assert [r["vec_id"] for r in got.orderBy("vec_id").collect()] == [1, 9] and sorted(at.tolist()) == [[-1, 128], [256, 512]]
    empty, none = k_means(df.limit(0), 4, 3, dims=2)
    assert empty.count() == 0 and len(none) == 0 and centroids.inertias(empty, none).count() == 0


def test_refuses_what_is_not_exact(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], 0, "c", 1, "v")], SCHEMA)
    with pytest.raises(ValueError, match="exact"):
        k_means(df, 1, 1, dims=2)


def test_wide_components_are_exact():
    rng = np.random.default_rng(1)
    v, c = (rng.integers(-centroids.MOST, centroids.MOST, (20, 64)) for _ in range(2))
    assert squares(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
    assert centroids._unpacked(centroids._packed(v), 64).tolist() == v.tolist()


def test_bounds_save_scans():
    """After small moves few vectors are scanned, and none has another cluster than a scan gives; equal centroids send ties to the first."""
    rng = np.random.default_rng(2)
    at = rng.integers(-2000, 2000, (20, 16))
    at[11] = at[4]
    v = at[rng.integers(0, 20, 5000)] + rng.integers(-60, 60, (5000, 16))
    near, _, upper, lower = Centroids(at).scan(v)
    scanned = []
    for _ in range(4):
        before, at = at, at + rng.integers(-3, 4, at.shape)
        near, upper, lower, n = Centroids(at, before).moved(v, near, upper, lower)
        scanned.append(n)
        assert (near == squares(v, at).argmin(1)).all()
    assert max(scanned) < 1500


def test_query_is_the_contract(spark, sf):
    got = registry.QUERIES["op11_clusters"](spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    r = got.first()
    assert r["inertia"] == got.agg({"distance": "sum"}).first()[0] and len(r["centroid_sha256"]) == 64
