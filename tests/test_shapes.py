"""Shapes of point sets on made-up points, against plain versions."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripweave.functions import geometry as geo
from stripweave.operators import axes, candidates, density, graph, links, moments


def frame(spark, rows):
    return spark.createDataFrame(rows, "grp long, id long, x double, y double, z double")


def plain_trim(p, factor=2.0, least=10):
    c, dropped = 1.0, 0
    while len(p) >= least:
        center = p.mean(0)
        _, vectors = np.linalg.eigh(np.cov(p.T, bias=True))
        off = p - center
        d = np.linalg.norm(off - np.outer(off @ vectors[:, -1], vectors[:, -1]), axis=1)
        order = np.argsort(d, kind="stable")
        p, d = p[order], d[order]
        at, n = d[int(0.68 * len(p))], len(p)
        while len(p) and d[len(p) - 1] / at > c:
            p, c = p[:-1], factor
        dropped += n - len(p)
        factor *= 2
        if n == len(p) or len(p) < 3:
            break
    return len(p), dropped


def test_trimmed_moments_equal_plain(spark):
    rng = np.random.default_rng(2)
    sets = {g: rng.normal(size=(n, 3)) * [5, 1, 0.5] + rng.choice([0, 0, 0, 30], size=(n, 3)) for g, n in ((1, 60), (2, 40), (3, 9), (4, 25))}
    rows = [(g, k, *map(float, r)) for g, p in sets.items() for k, r in enumerate(p)]
    got = {r["grp"]: (r["n"], r["n_dropped"]) for r in axes.trimmed_moments(frame(spark, rows)).collect()}
    assert got == {g: plain_trim(p) for g, p in sets.items()}


def test_axis_is_the_first_eigenvector(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(50, 3)) @ np.array([[3, 1, 2], [0, 1, 0.3], [0, 0, 0.2]])
    got = axes.with_axis(moments.principal(moments.scatter(frame(spark, [(0, k, *map(float, r)) for k, r in enumerate(p)]), "grp"))).first()
    want = np.linalg.eigh(np.cov(p.T, bias=True))[1][:, -1]
    assert np.abs(np.dot([got["ax"], got["ay"], got["az"]], want)) == pytest.approx(1, abs=1e-6)


def kruskal(n, edges):
    root, out = list(range(n)), []

    def top(x):
        return x if root[x] == x else top(root[x])

    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if top(a) != top(b):
            root[top(a)] = top(b)
            out.append((a, b, w))
    return out


def test_forest_equals_kruskal(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(rng.integers(1, 6))) for a, b in rng.integers(0, 30, (70, 2)) if a < b]
    edges = [(a, b, w) for (a, b), w in {(a, b): w for a, b, w in edges}.items()]
    got = density.spanning_forest(spark.range(32), spark.createDataFrame(edges, "a long, b long, w double"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(kruskal(32, edges))
    sizes = sorted(r["size"] for r in density.trees_of(spark.range(32), got).collect())
    assert sum(1 / s for s in sizes) == pytest.approx(32 - len(kruskal(32, edges)))


def test_long_edges_are_cut(spark):
    forest = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 4, 9.0), (2, 8, 9, 2.0)], "tree long, a long, b long, w double")
    assert {(r["a"], r["b"]) for r in density.cut_forest(forest, 2.0, 1.5).collect()} == {(1, 2), (2, 3), (8, 9)}


def test_bin_clusters_merge_on_contact_and_drop_noise(spark):
    rows = [(1, 0, 0, 0, 5, 3), (1, 1, 1, 0, 1, 1), (1, 2, 1, 1, 1, 1), (1, 9, 9, 9, 4, 1), (1, 20, 0, 0, 2, 3), (2, 0, 0, 0, 1, 7)]
    got = {(r["grp"], r["bx"]): r["label"] for r in density.bin_clusters(spark.createDataFrame(rows, "grp long, bx int, by_ int, bz int, n long, layers int"), 2, 2).collect()}
    assert got[(1, 0)] == got[(1, 1)] == "1:0:0:0"
    assert got[(1, 9)] is None
    assert got[(1, 20)] == "1:20:0:0"
    assert got[(2, 0)] == "2:0:0:0"
    assert got[(1, 2)] is None  # its one neighbour holds a single point


def plain_set(rows, share=0.67, own=4, most=10):
    out = {}
    for event in {r[0] for r in rows}:
        used, taken = set(), []
        for _, c, _, hits in sorted((r for r in rows if r[0] == event), key=lambda r: (-r[2], r[1])):
            if len(set(hits) - used) >= min(share * len(set(hits)), own) and len(taken) < most:
                taken.append(c)
                used |= set(hits)
        out[event] = taken
    return out


def test_candidate_set_equals_plain(spark):
    rng = np.random.default_rng(5)
    rows = [(int(e), k, float(rng.integers(0, 9)), [int(x) for x in rng.integers(0, 40, rng.integers(1, 9))]) for k, e in enumerate(rng.integers(0, 4, 90))]
    got = collections.defaultdict(dict)
    for r in candidates.candidate_set(spark.createDataFrame(rows, "event long, candidate long, quality double, hits array<long>")).collect():
        got[r["event"]][r["place"]] = r["candidate"]
    assert {e: [x for _, x in sorted(c.items())] for e, c in got.items()} == plain_set(rows)


def test_leave_one_out_equals_a_fit_of_the_others(spark):
    rng = np.random.default_rng(6)
    z, y = np.arange(9.0), rng.normal(size=9)
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(z, y, strict=True)], "g long, z double, y double")
    got = {r["z"]: r["residual"] for r in moments.leave_one_out(rows, ["g"], 4).collect()}
    for k in range(9):
        slope, intercept = np.polyfit(np.delete(z, k), np.delete(y, k), 1)
        assert got[float(k)] == pytest.approx(y[k] - slope * z[k] - intercept)


def test_gates_take_the_closest_approach(spark):
    k = spark.createDataFrame([(1, 0, 0, 0, 0, 5, 1), (1, 1000, 0, 1000, 0, 5, 1)], "event long, top_x long, top_y long, bot_x long, bot_y long, top_layer int, step int")
    got = [r["doca"] for r in links.gated(k, spark.createDataFrame([(1, 3.0, 4.0, 77.0)], "event long, cx double, cy double, cz double"), 150.0, 30.0).orderBy("top_x").collect()]
    assert got == pytest.approx([5.0, np.hypot(225, 4)], abs=1e-5)


def test_threshold_is_a_smooth_step(spark):
    import math

    rows = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "x double").select("x", geo.threshold(F.col("x")).alias("t")).collect()
    assert all(abs(r["t"] - 0.5 * math.erfc(r["x"])) < 1e-4 for r in rows)
    size, separation, least = density.bin_parameters(F.col("n"))
    got = [tuple(r) for r in spark.createDataFrame([(1,), (31,), (32,), (10**9,)], "n long").select(size, separation, least).collect()]
    assert got == [(15.0, 8, 2), (15.0, 8, 2), (15.0, 6, 3), (20.0, 2, 10)]


def plain_reweighted(p, factor, flat=0.25):
    """Size, dropped, rounds, axis of one group's points."""
    center, w, limit, dropped, rounds, axis = p.mean(0), np.ones(len(p)), factor, 0, 0, None
    while True:
        off = p - center
        m = (w[:, None, None] * off[:, :, None] * off[:, None, :]).sum(0)
        values, vectors = np.linalg.eigh(m / w.sum())
        if len(p) < 2 or values[2] <= 1e-24:
            return len(p), dropped, rounds, axis
        axis = vectors[:, 2] * (1 if vectors[2, 2] >= 0 else -1)
        rounds += 1
        size = np.sqrt(np.sqrt(max(0.0, values[0] + values[1])) / w.sum())
        d = np.linalg.norm(np.cross(off, axis), axis=1)
        center = (w[:, None] * p).sum(0) / w.sum()
        if rounds == 1 and abs(axis[2]) < flat:
            axis = np.array([0.0, 0.0, 1.0])
            d = np.linalg.norm(np.cross(p - center, axis), axis=1)
            size = (d.max() - 1) / limit
        gone = d > limit * size
        if not gone.any():
            return len(p), dropped, rounds, axis
        dropped += int(gone.sum())
        p, d, limit = p[~gone], d[~gone], limit * 2
        w = np.where(d > 0, 1 / np.where(d > 0, d, 1), 1000.0)


@pytest.mark.parametrize("factor", [1.0, 2.0])
def test_reweighted_moments_equal_plain(spark, factor):
    rng = np.random.default_rng(8)
    sets = {g: rng.normal(size=(n, 3)) * spread for g, n, spread in ((1, 60, [1, 1, 9]), (2, 40, [0.1, 0.2, 3]), (3, 30, [9, 1, 0.5]), (4, 25, [0.01, 0.01, 1]), (5, 3, [1, 1, 1]), (6, 1, [1, 1, 1]))}
    sets[7] = np.zeros((4, 3))
    sets[1][:3] += [40, 0, 0]
    rows = [(g, k, *map(float, x)) for g, p in sets.items() for k, x in enumerate(p)] + [(1, 999, None, 0.0, 0.0)]
    got = {r["grp"]: r for r in axes.reweighted_moments(spark.createDataFrame(rows, "grp int, id int, x double, y double, z double"), factor).collect()}
    assert set(got) == set(sets)
    for g, p in sets.items():
        n, dropped, rounds, axis = plain_reweighted(p, factor)
        assert (got[g]["n"], got[g]["n_dropped"], got[g]["n_rounds"]) == (n, dropped, rounds), g
        assert axis is None or [got[g]["ax"], got[g]["ay"], got[g]["az"]] == pytest.approx(list(axis), abs=1e-6)
    assert sum(r["n_dropped"] for r in got.values()) > 3


def test_components_of_a_long_path_settle(spark):
    """A path in random order: rounds don't grow with its length."""
    p = np.random.default_rng(6).permutation(600).tolist()
    edges = spark.createDataFrame(list(zip(p[:-1], p[1:], strict=True)), "a long, b long")
    got = graph.components(spark.range(602), edges, most_rounds=16).collect()
    assert {(r["id"], r["label"]) for r in got} == {(k, 0 if k < 600 else k) for k in range(602)}


def near_edges(rows, size):
    out = []
    for i, (g, a, *p) in enumerate(rows):
        for h, b, *q in rows[i + 1 :]:
            d2 = sum((u - v) ** 2 for u, v in zip(p, q, strict=True))
            if g == h and d2 <= size * size:
                out.append((min(a, b), max(a, b), d2**0.5))
    return out


@pytest.mark.parametrize("crowd", [12, 1000])
def test_near_forest_equals_kruskal_over_all_near_pairs(spark, crowd):
    """Grid points tie, some places hold several points, one group is a knot of near copies beside a far one; whatever the first distance."""
    rng = np.random.default_rng(7)
    rows = [(1, k, *map(float, rng.integers(0, 5, 3) / 8)) for k in range(90)] + [(2, 100 + k, *map(float, rng.normal(size=3) / 6)) for k in range(80)]
    rows += [(3, 200 + k, *map(float, 1 + rng.normal(size=3) / 100)) for k in range(40)] + [(3, 250 + k, 1.2, 1.0, 1.0 + k / 50) for k in range(4)] + [(3, 260, 9.0, 9.0, 9.0)]
    rng.shuffle(rows)
    rows = [(int(g), int(k), *map(float, p)) for g, k, *p in rows]
    got = density.near_forest(frame(spark, rows), 0.25, crowd).collect()
    told = lambda found: sorted((a, b, round(w, 12)) for a, b, w in found)
    assert told(got) == told(kruskal(300, near_edges(rows, 0.25)))
