"""The guard of the first pass refuses events of more than 2000 clusters, and says so."""

from stripweave.jobs import registry


def test_refused_events_stay_in_the_result(spark, tmp_path):
    rows = [(k, user, (k % 1500) / 100) for user, n in ((1, 2001), (2, 2000), (3, 76)) for k in range(0, 36 * n, 36)]
    rows += [(k, 3, 0.5) for k in (19, 18)]  # the other view, in layers 1 and 0
    rows += [(1, 3, 0.5)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event"]: (r["refused"], r["n_links"] > 0) for r in registry.QUERIES["r1_whole_first_pass"](spark, str(tmp_path)).collect()}
    assert got == {1: (True, False), 3: (False, True)}  # event 2 is let in but has no points
