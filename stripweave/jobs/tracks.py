"""Queries on seeds, tracks, vertices and associations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fit, graph
from ..operators import points as pts
from ..sources.hits import SQL_ORDERS, SQL_POINTS, SQL_USERS, label_points, order_hits, table, user_hits
from .reconstruct import Config, first_pass
from .register import query

L, E, V = f"WITH {SQL_ORDERS}", f"WITH {SQL_USERS}", f"WITH {SQL_POINTS}"


@query("j11_nearest_partner", f"{V}, c AS (SELECT grp, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v GROUP BY grp), d AS (SELECT v.id, c.grp AS partner, round((x-cx)**2 + (y-cy)**2 + (z-cz)**2, 6) AS d2 FROM v LEFT JOIN c ON abs(v.grp - c.grp) <= 1 AND c.grp <> v.grp) SELECT id, CASE WHEN d2 <= 0.08 THEN partner ELSE -1 END::INT AS partner FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2 NULLS LAST, partner) AS r FROM d) WHERE r = 1")
def nearest_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree takes the nearest gated cluster; trees without one have partner -1."""
    v = label_points(spark, sf_dir)
    c = v.groupBy(F.col("grp").alias("partner")).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    gates = v.withColumn("partner", F.explode(F.array(F.col("grp") - 1, F.col("grp") + 1)))
    d2 = F.round((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2, 6)
    d = gates.join(c, "partner", "left").withColumn("d2", d2).withColumn("found", F.when(F.col("d2").isNotNull(), F.col("partner")))
    best = d.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("d2").asc_nulls_last(), "partner"))).filter("r = 1")
    return best.select("id", F.when(F.col("d2") <= 0.08, F.col("found")).otherwise(-1).alias("partner"))


@query("j13_track_pairs", "SELECT a.o_custkey AS event, count(*) AS n_pairs, round(max(abs(a.o_totalprice - b.o_totalprice)), 2) AS most_apart FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey")
def track_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("p"))
    b = o.select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("j"), F.col("o_totalprice").alias("q"))
    return a.join(b, "event").filter("i < j").groupBy("event").agg(F.count("*").alias("n_pairs"), F.round(F.max(F.abs(F.col("p") - F.col("q"))), 2).alias("most_apart"))


SEEDS = f"""{E}, s AS (SELECT a.event, a.hit AS h1, b.hit AS h2, c.hit AS h3, a.layer, abs(a.strip - 2 * b.strip + c.strip) AS bend FROM e a JOIN e b ON a.event = b.event AND a.view = b.view AND b.layer = a.layer - 1 JOIN e c ON c.event = b.event AND c.view = b.view AND c.layer = b.layer - 1)
SELECT event, h1, h2, h3, bend FROM (SELECT *, row_number() OVER (PARTITION BY event, h1, h2 ORDER BY bend, h3) AS r FROM s) WHERE r = 1 AND bend < 40"""


@query("p1_triplet_seeds", SEEDS)
def triplet_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits of neighbouring layers and the third that bends least, if it bends little."""
    e = user_hits(spark, sf_dir)
    a = e.select("event", "view", "layer", F.col("strip").alias("s1"), F.col("hit").alias("h1"))
    b = e.select("event", "view", (F.col("layer") + 1).alias("layer"), F.col("strip").alias("s2"), F.col("hit").alias("h2"))
    c = e.select("event", "view", (F.col("layer") + 2).alias("layer"), F.col("strip").alias("s3"), F.col("hit").alias("h3"))
    t = a.join(b, ["event", "view", "layer"]).join(c, ["event", "view", "layer"]).withColumn("bend", F.abs(F.col("s1") - 2 * F.col("s2") + F.col("s3")))
    w = Window.partitionBy("event", "h1", "h2").orderBy("bend", "h3")
    return t.withColumn("r", F.row_number().over(w)).filter("r = 1 AND bend < 40").select("event", "h1", "h2", "h3", "bend")


@query("p2_predicted_neighbours", f"{E}, q AS (SELECT a.event, a.hit AS h1, b.hit AS h2, abs(b.strip - (a.strip * 2 - 768)) AS off FROM e a JOIN e b ON a.event = b.event AND a.view = b.view AND b.layer = a.layer - 1) SELECT event, h1, h2, rank FROM (SELECT *, row_number() OVER (PARTITION BY event, h1 ORDER BY off, h2) AS rank FROM q) WHERE rank <= 3")
def predicted_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_hits(spark, sf_dir)
    a = e.select("event", "view", "layer", F.col("strip").alias("s1"), F.col("hit").alias("h1"))
    b = e.select("event", "view", (F.col("layer") + 1).alias("layer"), F.col("strip").alias("s2"), F.col("hit").alias("h2"))
    off = F.abs(F.col("s2") - (F.col("s1") * 2 - 768))
    rank = F.row_number().over(Window.partitionBy("event", "h1").orderBy(off, "h2")).cast("long")
    return a.join(b, ["event", "view", "layer"]).select("event", "h1", "h2", rank.alias("rank")).filter("rank <= 3")


@query("p10_truth_segments", "WITH o AS (SELECT user_id AS particle, event_id, value, (event_id % 18) AS layer, lag(event_id % 18) OVER w AS before, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN before IS NULL OR abs(layer - before) > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY particle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM o) SELECT particle, segment::BIGINT AS segment, count(*) AS n_hits, min(event_id) AS first_hit, round(sum(value), 4) AS energy FROM s GROUP BY ALL HAVING count(*) >= 3")
def truth_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A particle's hits in time, cut where the plane jumps; short pieces go."""
    w = Window.partitionBy("particle").orderBy("ts", "event_id")
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("particle"), "event_id", "value", "ts", (F.col("event_id") % 18).alias("layer"))
    cut = F.when(F.lag("layer").over(w).isNull() | (F.abs(F.col("layer") - F.lag("layer").over(w)) > 4), 1).otherwise(0)
    s = o.withColumn("cut", cut).withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("particle", "segment").agg(F.count("*").alias("n_hits"), F.min("event_id").alias("first_hit"), F.round(F.sum("value"), 4).alias("energy")).filter("n_hits >= 3")


@query("h3_missing_reasons", f"{L} SELECT event, price, CASE WHEN width = 8 THEN 'dead plane' WHEN strip < 20 OR strip > 1515 THEN 'tower edge' WHEN strip % 384 < 10 THEN 'wafer gap' WHEN tower = 1 AND layer > 5 THEN 'truncated' WHEN price % 97 = 0 THEN 'dead strips' ELSE 'unknown' END AS reason FROM l")
def missing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a plane has no hit: the first reason of an ordered list."""
    s = F.col("strip")
    r = F.when(F.col("width") == 8, "dead plane").when((s < 20) | (s > 1515), "tower edge").when(s % 384 < 10, "wafer gap").when((F.col("tower") == 1) & (F.col("layer") > 5), "truncated").when(F.col("price") % 97 == 0, "dead strips").otherwise("unknown")
    return order_hits(spark, sf_dir).select("event", "price", r.alias("reason"))


@query("h7_alignment", f"{L}, a AS (SELECT layer, view, avg(strip) - 768 AS shift FROM l GROUP BY ALL) SELECT l.event, l.price, round(l.strip - a.shift * 0.01, 4) AS aligned FROM l JOIN a USING (layer, view)")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured coordinates shifted by a table with a row for each plane (at most 36, so it is broadcast)."""
    rows = order_hits(spark, sf_dir)
    shifts = rows.groupBy("layer", "view").agg((F.avg("strip") - 768).alias("shift"))
    return rows.join(F.broadcast(shifts), ["layer", "view"]).select("event", "price", F.round(F.col("strip") - F.col("shift") * 0.01, 4).alias("aligned"))


@query("x1_vertex_partners", f"{V}, p AS (SELECT a.grp, a.id AS first, b.id AS second, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 6) AS doca FROM v a JOIN v b ON a.grp = b.grp AND a.id < b.id) SELECT grp, first, second, doca, (CASE WHEN doca < 0.2 THEN 1 ELSE 0 END) | (CASE WHEN (first + second) % 2 = 0 THEN 2 ELSE 0 END) | 8 AS topology FROM (SELECT *, row_number() OVER (PARTITION BY grp, first ORDER BY doca, second) AS r FROM p) WHERE r = 1")
def vertex_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best partner of each track of an event, with topology bits."""
    best = pts.nearest_later(label_points(spark, sf_dir))
    bits = F.when(F.col("doca") < 0.2, 1).otherwise(0).bitwiseOR(F.when((F.col("first") + F.col("second")) % 2 == 0, 2).otherwise(0)).bitwiseOR(F.lit(8))
    return best.select("grp", "first", "second", "doca", bits.alias("topology"))


@query("x3_weighted_vertex", f"{V} SELECT grp, round(sum(x / (0.01 + abs(z))) / sum(1 / (0.01 + abs(z))), 5) AS x, round(sum(y / (0.02 + abs(z))) / sum(1 / (0.02 + abs(z))), 5) AS y, round(1 / sum(1 / (0.01 + abs(z))), 7) AS var_x, round(1 / sum(1 / (0.02 + abs(z))), 7) AS var_y FROM v GROUP BY grp")
def weighted_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates combined by inverse variances, view by view."""
    wx, wy = 1 / (0.01 + F.abs("z")), 1 / (0.02 + F.abs("z"))
    s = label_points(spark, sf_dir).groupBy("grp").agg(F.sum(F.col("x") * wx).alias("sx"), F.sum(F.col("y") * wy).alias("sy"), F.sum(wx).alias("wx"), F.sum(wy).alias("wy"))
    return s.select("grp", F.round(F.col("sx") / F.col("wx"), 5).alias("x"), F.round(F.col("sy") / F.col("wy"), 5).alias("y"), F.round(1 / F.col("wx"), 7).alias("var_x"), F.round(1 / F.col("wy"), 7).alias("var_y"))


@query("t13_tree_order", f"{V}, t AS (SELECT grp, count(*) AS len, round(stddev_pop(x) / (count(*) * count(*)), 9) AS score FROM v GROUP BY grp) SELECT grp, len, rank FROM (SELECT *, row_number() OVER (ORDER BY score, grp) AS rank FROM t) WHERE rank <= 10")
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten trees by rms over squared length; ties by id. A top-k report: only ten rows are ranked."""
    t = label_points(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("len"), F.round(F.stddev_pop("x") / (F.count("*") * F.count("*")), 9).alias("score"))
    best = t.orderBy("score", "grp").limit(10)
    return best.select("grp", "len", F.row_number().over(Window.orderBy("score", "grp")).cast("long").alias("rank"))


@query("n6_event_defaults", "SELECT c_custkey AS event, coalesce(e, 30.0) AS energy, CASE WHEN spread > 0.1 THEN round(spread, 4) ELSE 500.0 END AS rms FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS e, stddev_pop(o_totalprice) AS spread FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def event_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("e"), F.stddev_pop("o_totalprice").alias("spread"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event"))
    return c.join(o, F.col("event") == F.col("o_custkey"), "left").select("event", F.coalesce("e", F.lit(30.0)).alias("energy"), F.when(F.col("spread") > 0.1, F.round("spread", 4)).otherwise(500.0).alias("rms"))


@query("g6_single_linkage", f"WITH RECURSIVE {SQL_POINTS}, ed AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.grp = b.grp AND a.id <> b.id WHERE (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 <= 0.0025), r AS (SELECT id, id AS seen FROM v UNION SELECT r.id, ed.b FROM r JOIN ed ON r.seen = ed.a) SELECT id, min(seen) AS label FROM r GROUP BY id")
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage cut at a distance: components of the edges below it (of G6, single linkage alone)."""
    v = label_points(spark, sf_dir)
    return graph.components(v, graph.near_pairs(v, 0.05))


@query("k7_track_fits")
def track_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-state filter and smoother for each event and view (K1 to K5, K7)."""
    return fit.track_fits(user_hits(spark, sf_dir).withColumn("m", F.col("strip") / 100.0))


@query("r1_first_pass", f"{E}, big AS (SELECT event FROM e GROUP BY event HAVING count(*) > 2000), p AS (SELECT a.event, a.layer, a.strip AS x, b.strip AS y FROM e a JOIN e b USING (event, layer) WHERE a.view = 0 AND b.view = 1 AND a.event NOT IN (SELECT event FROM big)), k AS (SELECT t.event, t.layer FROM p t JOIN p b ON t.event = b.event AND t.layer - b.layer BETWEEN 1 AND 2 WHERE (t.x-b.x)*(t.x-b.x) + (t.y-b.y)*(t.y-b.y) <= 250000) SELECT event, count(*) AS n_links, count(DISTINCT layer) AS n_layers FROM k GROUP BY event")
def first_pass_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_pass(user_hits(spark, sf_dir), Config(skip=1)).summary


@query("r1_whole_first_pass", f"{E}, big AS (SELECT event FROM e GROUP BY event HAVING count(*) > 2000), p AS (SELECT a.event, a.layer, a.strip AS x, b.strip AS y FROM e a JOIN e b USING (event, layer) WHERE a.view = 0 AND b.view = 1 AND a.event NOT IN (SELECT event FROM big)), k AS (SELECT t.event, t.layer FROM p t JOIN p b ON t.event = b.event AND t.layer - b.layer BETWEEN 1 AND 2 WHERE (t.x-b.x)*(t.x-b.x) + (t.y-b.y)*(t.y-b.y) <= 250000) SELECT event, count(*) AS n_links, count(DISTINCT layer) AS n_layers, false AS refused FROM k GROUP BY event UNION ALL SELECT event, 0, 0, true FROM big")
def whole_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pass under the reference's guard of 2000 clusters (F3); refused events stay as rows of their own."""
    found = first_pass(user_hits(spark, sf_dir), Config(skip=1))
    refused = found.errors.select("event", F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_layers"), F.lit(True).alias("refused"))
    return found.summary.withColumn("refused", F.lit(False)).unionByName(refused)
