"""Tables bucketed by event: no exchange in what reads them, and batches that may run again."""

from pyspark.sql import functions as F

from stripweave.jobs import hits, registry, trees
from stripweave.operators import links as lnk
from stripweave.operators import trees as grow
from stripweave.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_points(spark, sf, name):
    return store.save(hits.user_points(spark, sf), name, 4, ("layer",))


def test_links_and_growth_need_no_exchange(spark, sf):
    points = stored_points(spark, sf, "points_a")
    with store.setting(spark, store.CO_PARTITION, "false"), store.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        dx, dy = F.col("top_x") - F.col("bot_x"), F.col("top_y") - F.col("bot_y")
        band = dx * dx + dy * dy <= 250000
        adjacent = lnk.links(points, 0, band).groupBy("event").agg(F.count("*").alias("n_links"), F.max(dx * dx + dy * dy).alias("most_d2"))
        assert "Exchange" not in plan(adjacent)
        expected = registry.QUERIES["j3_adjacent_links"](spark, sf).select("event", "n_links", "most_d2")
        assert sorted(map(tuple, adjacent.collect())) == sorted(map(tuple, expected.collect()))
        grown = grow.grow(trees.with_clusters(lnk.links(points, trees.SKIP, band, ("x_hit", "y_hit"))))
        assert "Exchange" not in plan(grown)
        assert sorted(r["path"] for r in grown.collect()) == sorted(r["path"] for r in trees.grown(spark, sf).collect())


def test_a_run_is_replaced_by_itself_alone(spark):
    rows = lambda run, n: spark.createDataFrame([(run, e, e % 3) for e in range(n)], "run long, event long, layer int")
    store.save(rows(1, 10), "runs_a", 2, ("layer",), run="run")
    store.save(rows(2, 5), "runs_a", 2, ("layer",), run="run")
    found = store.save(rows(2, 7), "runs_a", 2, ("layer",), run="run")
    assert {r["run"]: r["count"] for r in found.groupBy("run").count().collect()} == {1: 10, 2: 7}
    assert store.save(rows(3, 0), "runs_a", 2, ("layer",), run="run").count() == 17


def test_modules_import_alone():
    import subprocess
    import sys

    names = ["attributes", "estimates", "following", "hits", "reconstruct", "registry", "selections", "shapes", "tracks", "trees"]
    for name in names:
        subprocess.run([sys.executable, "-c", f"import stripweave.jobs.{name}"], check=True, timeout=60)
