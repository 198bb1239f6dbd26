import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetsieve.operators import kmeans
from packetsieve.operators.isoforest import (
    FLAG,
    SCORE,
    fit_forest,
    mean_depth,
    priorities,
    sample_rows,
    uniform,
    uniform_of,
    with_iso_score,
)
from packetsieve.operators.kmeans import CLUSTER, DISTANCE, assign, fit_restarts, lloyd_rounds
from packetsieve.operators.scoring import score_rows, summarise
from packetsieve.schema import FEATURES, ROW_ID


def features_of(spark, matrix):
    rows = [(i, *map(float, r)) for i, r in enumerate(matrix)]
    schema = f"{ROW_ID} long, " + ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(rows, schema)


def blobs(n, k=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 50, (k, len(FEATURES)))
    return centres[np.arange(n) % k] + rng.normal(0, 1, (n, len(FEATURES)))


def nearest(x, centres):
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), np.sqrt(d.min(axis=1))


def test_assignment_and_ties(spark):
    x = np.vstack([blobs(50), np.zeros((1, len(FEATURES)))])
    far = np.full(len(FEATURES), 100.0)
    ones = np.ones(len(FEATURES))
    centres = np.vstack([far, ones, -ones])
    got = assign(features_of(spark, x), list(enumerate(centres.tolist()))).orderBy(ROW_ID).collect()
    label, distance = nearest(x, centres)
    assert [r[CLUSTER] for r in got] == label.tolist()
    assert np.allclose([r[DISTANCE] for r in got], distance)
    assert got[-1][CLUSTER] == 1


def test_lloyd_rounds_against_numpy(spark):
    x = blobs(300, k=5, seed=2)
    start = np.vstack([x[:3], np.full((1, len(FEATURES)), 1e4)])
    want = start.copy()
    for _ in range(3):
        label, _ = nearest(x, want)
        want = np.array([x[label == k].mean(axis=0) if (label == k).any() else want[k] for k in range(4)])
    got = lloyd_rounds(features_of(spark, x).repartition(3), list(enumerate(start.tolist())), 3)
    assert [k for k, _ in got] == [0, 1, 2, 3]
    assert np.allclose([c for _, c in got], want)


def test_restarts_find_the_blobs(spark):
    x = blobs(400)
    fits = fit_restarts(features_of(spark, x), 4)
    costs = [cost for cost, _ in fits]
    assert costs == sorted(costs) and len(fits) == 4
    for cost, centres in fits:
        table = np.array([c for _, c in centres])
        assert table.shape == (8, len(FEATURES)) and np.isfinite(table).all()
        assert cost == pytest.approx((nearest(x, table)[1] ** 2).sum(), rel=1e-6)
    assert costs[0] < 2 * 400 * len(FEATURES)
    settled = lloyd_rounds(features_of(spark, x), fits[0][1], 1)
    assert np.allclose([c for _, c in settled], [c for _, c in fits[0][1]], atol=1e-3)


def test_restarts_do_not_depend_on_partitions(spark):
    df = features_of(spark, blobs(200, seed=4))
    one = fit_restarts(df.coalesce(1), 2)
    many = fit_restarts(df.repartition(8), 2)
    assert np.allclose([c for c, _ in one], [c for c, _ in many])


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="cannot form 8 clusters"):
        fit_restarts(features_of(spark, blobs(3)), 1)
    with pytest.raises(ValueError):
        fit_restarts(features_of(spark, blobs(0)), 1)


def test_equal_rows_cluster(spark):
    fits = fit_restarts(features_of(spark, np.ones((20, len(FEATURES)))), 1)
    assert fits[0][0] == pytest.approx(0.0)


def test_uniform_is_the_same_in_both_places(spark):
    texts = ["42|0|1", "42|cut|3|7", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(uniform(F.col("t"))).collect()] == [uniform_of(t) for t in texts]


def walk(nodes, row):
    node = 1
    while nodes[node]["feature"] >= 0:
        n = nodes[node]
        node = n["left"] if row[n["feature"]] <= n["threshold"] else n["right"]
    return nodes[node]["depth"] + mean_depth(nodes[node]["n_samples"])


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1200])
def test_forest_shape_and_scores(spark, n):
    x = blobs(n, k=3, seed=n)
    df = features_of(spark, x)
    forest = fit_forest(df, 5)
    nodes = forest.collect()
    sample = min(n, 256)
    trees = {}
    for r in nodes:
        trees.setdefault(r["tree"], {})[r["node"]] = r
    assert len(trees) == 5
    for tree in trees.values():
        assert tree[1]["n_samples"] == sample
        leaves = [r for r in tree.values() if r["feature"] < 0]
        assert sum(r["n_samples"] for r in leaves) == sample
        assert all(r["depth"] == int(math.log2(r["node"])) <= 8 for r in tree.values())
        assert all(r["n_samples"] > 0 for r in tree.values())
    scored = with_iso_score(df, forest).orderBy(ROW_ID).collect()
    scale = mean_depth(sample) or 1.0
    for r, row in zip(scored[:60], x[:60]):
        path = np.mean([walk(tree, row) for tree in trees.values()])
        assert r[SCORE] == pytest.approx(0.5 - 2 ** (-path / scale))
        assert -0.5 <= r[SCORE] < 0.5 and r[FLAG] == (r[SCORE] < 0)


def test_equal_rows_make_single_leaves(spark):
    forest = fit_forest(features_of(spark, np.ones((50, len(FEATURES)))), 3).collect()
    assert [(r["node"], r["feature"], r["n_samples"]) for r in forest] == [(1, -1, 50)] * 3


def test_forest_does_not_depend_on_partitions(spark):
    df = features_of(spark, blobs(1500, seed=9))
    key = lambda r: (r["tree"], r["node"])
    one = sorted(fit_forest(df.coalesce(1), 3).collect(), key=key)
    many = sorted(fit_forest(df.repartition(8), 3).collect(), key=key)
    assert one == many


def test_summary(spark):
    df = features_of(spark, blobs(100))
    forest = fit_forest(df, 10)
    table = kmeans.centroid_table(spark, fit_restarts(df, 1)[0][1])
    scored = score_rows(df, table, forest)
    rows, report = scored.collect(), summarise(scored).first()
    scores = np.array([r[SCORE] for r in rows])
    distances = np.array([r[DISTANCE] for r in rows])
    assert report["rows"] == 100
    assert report["iso_score_mean"] == pytest.approx(scores.mean())
    assert report["iso_score_min"] == pytest.approx(scores.min())
    assert report["anomaly_ratio_iso"] == pytest.approx((scores < 0).mean())
    assert report["kmeans_distance_mean"] == pytest.approx(distances.mean())
    assert report["kmeans_distance_max"] == pytest.approx(distances.max())
    assert summarise(scored.limit(0)).first()["rows"] == 0


@pytest.mark.parametrize("driver_rows", [0, 1 << 15])
def test_marked_passes_give_the_centres_of_full_passes(spark, monkeypatch, driver_rows):
    monkeypatch.setattr(kmeans, "DRIVER_ROWS", driver_rows)
    monkeypatch.setattr(kmeans, "MARKED_SHARE", 0.95)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (9000, len(FEATURES))) * 0.1, np.zeros((50, len(FEATURES)))])
    x[:, :2] *= 30  # two directions without clusters: the centres move for long
    used = []
    totals = kmeans.Marks.totals
    monkeypatch.setattr(kmeans.Marks, "totals", lambda self, *a: used.append(self.rows) or totals(self, *a))
    with kmeans.packed(features_of(spark, x).repartition(3)) as blocks:
        start = kmeans.kmeans_plus_plus(blocks, 6, [1, 2, 3])
        limit = 1e-6 * blocks.variance
        want, active = start.copy(), np.arange(3)
        for _ in range(60):
            moved, _ = kmeans.lloyd_pass(blocks, want[active])
            shift = kmeans._shift(moved, want[active])
            want[active] = moved
            active = active[shift > limit]
            if not len(active):
                break
        got = kmeans.settled_centres(blocks, start, limit, 60)
        assert np.allclose(got, want, rtol=0, atol=1e-9)
        assert used and min(used) < blocks.rows / 2
        # A start that is not changed, and one centre only.
        assert np.array_equal(start, kmeans.kmeans_plus_plus(blocks, 6, [1, 2, 3]))
        one = kmeans.settled_centres(blocks, start[:, :1], 0.0, 9)
        assert np.allclose(one, 0.0, atol=1e-9)


def test_forest_samples_are_bottom_k(spark):
    ids = [i * i - 500 for i in range(3000)]
    df = spark.createDataFrame([(i,) for i in ids], f"{ROW_ID} long").repartition(7)
    want = set()
    for tree in range(5):
        h = priorities(np.array(ids), tree)
        order = np.lexsort((ids, h))
        want |= {(tree, ids[i]) for i in order[:256]}
    for slack in (2.0, 0.1):
        got = sample_rows(df, 5, slack=slack)
        assert {tuple(r) for r in got.collect()} == want
    few = sample_rows(df.where(f"{ROW_ID} < 0"), 2)
    assert few.count() == 2 * df.where(f"{ROW_ID} < 0").count()
    assert sample_rows(df.limit(0), 2).count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_marks_on_nearly_all_rows_are_not_kept(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (9000, len(FEATURES)))
    with kmeans.packed(features_of(spark, x).repartition(1)) as blocks:
        start = kmeans.kmeans_plus_plus(blocks, 6, [1, 2])
        few, most = (kmeans.marking_pass(blocks, start, np.arange(2), np.full((2, 6), pace)) for pace in (1e-6, 1e6))
        assert few.rows < kmeans.MARKED_SHARE * blocks.rows < most.rows
        assert most._held().count() == 0
        assert np.allclose(few.sums, most.sums, rtol=1e-9, atol=1e-6)
        few.drop(), most.drop()


def test_blocks_hold_repeated_values_as_codes_without_changing_any():
    r = np.random.default_rng(5)
    n = 3000
    values = np.column_stack([r.normal(size=n), r.integers(0, 4, n) / 3, r.integers(0, 900, n) / 7, np.where(r.random(n) < 0.5, -0.0, 0.0), np.full(n, np.nan)])
    for matrix in (values, values[:1], values[:0], values[:300]):
        coded = kmeans._coded(matrix)
        assert kmeans._decoded(coded, 5).tobytes() == matrix.tobytes()
    assert len(kmeans._coded(values)) < 0.5 * values.nbytes
