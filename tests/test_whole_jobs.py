"""Queries of the whole job on small made-up tables."""

import duckdb
import pytest
from pyspark.sql import Row

from stripweave.jobs import registry


def written_events(spark, tmp_path, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def straight_track(user):
    """A hit in each view of each layer, 80 strips further in each."""
    return [(18 * view + layer, user, 0.8 * layer) for view in (0, 1) for layer in range(18)]


def test_paths_walk_all_layers(spark, tmp_path):
    sf = written_events(spark, tmp_path, straight_track(3))
    got = sorted((r["n_links"], r["n_paths"]) for r in registry.QUERIES["t4_all_paths"](spark, sf).collect())
    assert got == [(n, 1) for n in range(2, 18)]


def test_kink_chains_take_all_links(spark, tmp_path):
    rows = [(i, u, v * 3) for i, u, v in straight_track(3) if i % 18 < 6]  # 240 strips apart
    got = registry.QUERIES["j8_all_kink_chains"](spark, written_events(spark, tmp_path, rows)).collect()
    assert [(r["event"], r["n_chains"]) for r in got] == [(3, 4)]


def test_first_member_is_one_whatever_the_order_of_rows(spark, tmp_path):
    """Members with equal strip and price: the signal is that of the lower part, in the SQL too."""
    fields = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double"
    rows = [(1, 1, 3, 40, 1.0, 10.0), (1, 2, 3, 20, 6.0, 10.0), (1, 3, 1, 20, 4.0, 10.0), (1, 4, 3, 30, 2.0, 10.0)]
    for k, order in enumerate((rows, rows[::-1])):
        sf = str(tmp_path / str(k))
        spark.createDataFrame(order, fields).coalesce(1).write.parquet(f"{sf}/lineitem.parquet")
        assert [r["signal"] for r in registry.QUERIES["c1_strip_islands"](spark, sf).collect()] == [5]
        con = duckdb.connect()
        con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet/*.parquet')")
        assert [r[0] for r in con.sql(f"SELECT signal FROM ({registry.ORACLES['c1_strip_islands']})").fetchall()] == [5]


@pytest.mark.parametrize("name", ["t10_ranked_leaves", "t12_leaf_hits", "o6_packed_tracks"])
def test_tied_leaves_equal_sql(spark, tmp_path, name):
    """Two hits on one strip: paths over either are equally straight and end at the same leaf."""
    at = lambda layer, view, strip, k: (36 * k + 18 * view + layer, 5, strip / 100)
    rows = [at(k, v, 500, 0) for k in (17, 16, 15) for v in (0, 1)] + [at(14, 0, 999, 0), at(14, 1, 500, 0), at(16, 0, 500, 1), at(16, 0, 500, 2)]
    sf = written_events(spark, tmp_path, rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet/*.parquet')")
    df, expected = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLES[name])
    assert sorted(map(repr, df.select(*expected.columns).collect())) == sorted(repr(Row(**dict(zip(expected.columns, r, strict=True)))) for r in expected.fetchall())
    if name == "t12_leaf_hits":
        assert {r["point_id"] for r in df.collect() if r["layer"] == 16} == {"16:34"}


def test_tasks_of_relations_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("stripweave.jobs.hits.ROWS_A_TASK", 100, raising=False)
    rows = [(k // 3, k % 2, k % 5) for k in range(1000)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = registry.QUERIES["s4_relations"](spark, str(tmp_path))
    want = {(a, b, n, len({r[2] for r in rows if r[:2] == (a, b)})) for a, b in {r[:2] for r in rows} if (n := sum(r[:2] == (a, b) for r in rows)) > 1}
    assert {tuple(r) for r in df.collect()} == want
    assert df.rdd.getNumPartitions() == 10
