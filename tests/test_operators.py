"""Operators on small made-up rows."""

import numpy as np
import pytest

from stripweave.jobs.reconstruct import Config, first_pass
from stripweave.operators import fit, graph, islands, kalman, links, moments, points
from stripweave.sources.hits import user_hits
from stripweave.streaming import batches


def test_islands_merge_and_break(spark):
    rows = spark.createDataFrame([(1, 10, 12), (1, 13, 20), (1, 30, 31), (2, 5, 5)], "event int, strip int, last_strip int")
    got = {(r["event"], r["strip"]): r["island"] for r in islands.islands(rows, ["event"], "strip", "last_strip", 3, []).collect()}
    assert got == {(1, 10): 1, (1, 13): 1, (1, 30): 2, (2, 5): 1}


def test_islands_of_empty_table(spark):
    rows = spark.createDataFrame([], "event int, strip int, last_strip int")
    assert islands.islands(rows, ["event"], "strip", "last_strip", 3, []).count() == 0


def test_paths_end_where_no_link_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 2, 5), (2, 1, 9)], "event int, top_id int, bot_id int")
    got = {(r["event"], r["head"], r["tail"], r["n_links"]) for r in links.paths(rows, 5).collect()}
    assert got == {(1, 1, 4, 3), (1, 1, 5, 2), (1, 2, 4, 2)}


def test_principal_moments_are_eigenvalues(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(60, 3)) * [3, 1, 0.2]
    df = spark.createDataFrame([(0, *map(float, r)) for r in p], "g int, x double, y double, z double")
    got = moments.principal(moments.scatter(df, "g")).first()
    want = np.linalg.eigvalsh(np.cov(p.T, bias=True))[::-1]
    assert [got["e1"], got["e2"], got["e3"]] == pytest.approx(want.tolist())


def test_scalar_filter_follows_the_recursion(spark):
    data = [(1, k, float(v)) for k, v in enumerate([3, 5, 4, 8])]
    got = kalman.scalar_filter(spark.createDataFrame(data, "g int, k int, m double"), "g", ["k"], "m", 0.5, 2.0).first()
    x, p, chi2 = 3.0, 2.0, 0.0
    for m in (5.0, 4.0, 8.0):
        p += 0.5
        chi2 += (m - x) ** 2 / (p + 2.0)
        x, p = x + p / (p + 2.0) * (m - x), p * (1 - p / (p + 2.0))
    assert (got["n"], got["x"], got["p"], got["chi2"]) == pytest.approx((4, x, p, chi2))


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(k,) for k in range(12)], "id long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)], "a long, b long")
    got = {r["id"]: r["label"] for r in graph.components(nodes, edges).collect()}
    assert got == {k: 0 if k < 9 else k for k in range(12)}


def test_fit_without_scattering_is_least_squares():
    rng = np.random.default_rng(8)
    z = np.arange(10.0)
    m = 3 + 0.7 * z + rng.normal(size=10)
    position, slope, variance, filtered, smoothed = fit.kalman_line(z, m, 1.0, 0.0)
    want = np.polyfit(z, m, 1)
    assert (slope, position) == pytest.approx(tuple(want), abs=1e-2)
    assert filtered == pytest.approx(smoothed, rel=1e-2)
    assert 0 < variance < 1


def test_first_pass_sets_large_events_aside(spark, sf):
    hits = user_hits(spark, sf)
    found = first_pass(hits, Config(most_clusters=60))
    large = {r["event"] for r in hits.groupBy("event").count().filter("count > 60").collect()}
    assert large
    assert {r["event"] for r in found.errors.collect()} == large
    assert not large & {r["event"] for r in found.summary.collect()}


def test_stream_equals_batch(spark, sf, tmp_path):
    hits = user_hits(spark, sf).repartition(3, "event")
    hits.write.parquet(str(tmp_path / "in"))
    batches.start(spark, str(tmp_path / "in"), hits.schema, str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=1).awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("event", "n_links", "n_layers").collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out/summary"))) == rows(first_pass(hits).summary)


def test_nearest_later_equals_plain(spark):
    """Ties, points at one place, single points, far ones and null coordinates, whatever the first width."""
    rng = np.random.default_rng(8)
    rows = [(1, k, *map(float, rng.integers(0, 4, 3) / 8)) for k in range(80)] + [(2, 100 + k, *map(float, rng.normal(size=3))) for k in range(60)]
    rows += [(3, 200, 0.0, 0.0, 0.0), (2, 170, 40.0, 0.0, 0.0), (2, 90, -40.0, 0.0, 0.0), (4, 210, 0.5, 0.5, 0.5), (4, 211, 0.5, 0.5, 0.5)]
    want = set()
    for g, a, *p in rows:
        later = [(round(sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) ** 0.5, 6), b) for h, b, *q in rows if h == g and b > a]
        if later:
            want.add((g, a, min(later)[1], min(later)[0]))
    df = spark.createDataFrame([*rows, (1, 300, None, 0.0, 0.0)], "grp long, id long, x double, y double, z double")
    for crowd in (4, 1000):
        assert {tuple(r) for r in points.nearest_later(df, crowd=crowd).collect()} == want
    assert points.nearest_later(df.limit(0)).count() == 0
