"""Queries on hits: clusters, points, links and their joins."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import order_key
from ..operators import islands as isl
from ..operators import links as lnk
from ..operators import points as pts
from ..sources import store
from ..sources.hits import SQL_ORDERS, SQL_USERS, order_hits, table, user_hits
from .register import query

L, E = f"WITH {SQL_ORDERS}", f"WITH {SQL_USERS}"
IDENT = ["part", "supp", "price"]
ROWS_A_TASK = 500_000


@query("s4_relations", "SELECT l_orderkey AS first_id, l_suppkey AS second_id, count(*) AS n_relations, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-way relation table keeps duplicates; both look-ups are equi-joins on one of the keys. Almost every row is a group of its own,
    so rows are dealt over as many tasks as hold ROWS_A_TASK each, and the memory of a task doesn't grow with the table."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    dealt = rows.repartition(math.ceil(rows.count() / ROWS_A_TASK) or 1, "l_orderkey", "l_suppkey")
    rel = dealt.groupBy(F.col("l_orderkey").alias("first_id"), F.col("l_suppkey").alias("second_id"))
    return rel.agg(F.count("*").alias("n_relations"), F.countDistinct("l_partkey").alias("n_distinct")).filter("n_relations > 1")


SQL_ISLANDS = f"""{L},
o AS (SELECT *, max(strip + width - 1) OVER w AS before FROM l WINDOW w AS (PARTITION BY event, view ORDER BY strip, part, supp, price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR strip - before > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY event, view ORDER BY strip, part, supp, price ROWS UNBOUNDED PRECEDING) AS island FROM o)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_hits(spark, sf_dir).withColumn("last_strip", F.col("strip") + F.col("width") - 1).withColumn("status", F.expr("shiftleft(1, layer)"))
    return isl.islands(rows, ["event", "view"], "strip", "last_strip", 40, IDENT)


@query("c1_strip_islands", SQL_ISLANDS + " SELECT event, view, island::BIGINT AS island, count(*) AS n_members, min(strip) AS first_strip, max(strip + width - 1) AS last_strip, bit_or((1 << layer)::INT) AS status, arg_min(width, (strip, price, part, supp, width)) AS signal, (min(strip) + max(strip + width - 1)) / 2 AS position FROM i GROUP BY event, view, island")
def strip_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strip runs become clusters; merged clusters take ends, or-ed status and the first member's signal."""
    return isl.merged(clusters(spark, sf_dir), ["event", "view"])


SQL_GAP = f"""{L},
g AS (SELECT event, view, (strip >= 768)::INT AS side, strip, width,
  strip - lag(strip) OVER (PARTITION BY event, view, strip >= 768 ORDER BY strip, part, supp, price) AS gap FROM l),
s AS (SELECT event, view, coalesce(floor(avg(gap) FILTER (side = 0) + 0.5), 5000) AS low,
  coalesce(floor(avg(gap) FILTER (side = 1) + 0.5), 5000) AS high, max(width) >= 6 AS truncated FROM g GROUP BY ALL)
SELECT event, view, CASE WHEN truncated THEN greatest(3, least(10, least(low, high) + 1)) ELSE 0 END::INT AS allowed FROM s"""


@query("c3_allowed_gap", SQL_GAP)
def allowed_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes with a wide hit stand for truncated ones; the others have no threshold."""
    rows = order_hits(spark, sf_dir).withColumn("side", (F.col("strip") >= 768).cast("int"))
    return isl.allowed_gap(rows, ["event", "view"], F.max("width") >= 6, ["part", "supp", "price"])


@query("c5_truncated_planes", f"{L} SELECT event, max(n)::BIGINT AS most_planes, max(n) > 3 AS triggered FROM (SELECT event, tower, count(DISTINCT layer * 2 + view) AS n FROM l WHERE width >= 4 GROUP BY ALL) GROUP BY event")
def truncated_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = order_hits(spark, sf_dir).filter("width >= 4").groupBy("event", "tower").agg(F.countDistinct(F.col("layer") * 2 + F.col("view")).alias("n"))
    return wide.groupBy("event").agg(F.max("n").alias("most_planes"), (F.max("n") > 3).alias("triggered"))


@query("c6_truncation_density", f"{L}, t AS (SELECT event, view, count(*) FILTER (strip < 768) AS c0, max(strip) FILTER (strip < 768) AS s0, min(strip) FILTER (strip < 768) AS f0, count(*) FILTER (strip >= 768) AS c1, min(strip) FILTER (strip >= 768) AS s1, max(strip) FILTER (strip >= 768) AS l1 FROM l GROUP BY ALL) SELECT event, view, CASE WHEN c0 < 2 THEN 0.0 ELSE round(c0 / (s0 - f0 + 1), 6) END AS low, CASE WHEN c1 = 0 THEN 0.0 ELSE round(c1 / (l1 - s1 + 1), 6) END AS high FROM t")
def truncation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("strip") < 768, F.col("strip") >= 768
    t = order_hits(spark, sf_dir).groupBy("event", "view").agg(F.count(F.when(low, 1)).alias("c0"), F.max(F.when(low, F.col("strip"))).alias("s0"), F.min(F.when(low, F.col("strip"))).alias("f0"), F.count(F.when(high, 1)).alias("c1"), F.min(F.when(high, F.col("strip"))).alias("s1"), F.max(F.when(high, F.col("strip"))).alias("l1"))
    return t.select("event", "view", F.when(F.col("c0") < 2, 0.0).otherwise(F.round(F.col("c0") / (F.col("s0") - F.col("f0") + 1), 6)).alias("low"), F.when(F.col("c1") == 0, 0.0).otherwise(F.round(F.col("c1") / (F.col("l1") - F.col("s1") + 1), 6)).alias("high"))


SQL_P = f"""{L}, p AS (SELECT a.event, a.layer, a.tower, a.strip AS x, b.strip AS y, a.price AS x_price, b.price AS y_price, a.part AS x_part, b.part AS y_part, a.supp AS x_supp, b.supp AS y_supp
  FROM l a JOIN l b USING (event, layer, tower) WHERE a.view = 0 AND b.view = 1)"""
SQL_EP = f"""{E}, p AS (SELECT a.event, a.layer, a.strip AS x, b.strip AS y, a.hit || ':' || b.hit AS id FROM e a JOIN e b USING (event, layer) WHERE a.view = 0 AND b.view = 1)"""


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.points(order_hits(spark, sf_dir), ["event", "layer", "tower"], ["price", "part", "supp"])


def user_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts.points(user_hits(spark, sf_dir), ["event", "layer"], ["hit"])
    return p.withColumn("id", pts.pair_id("x_hit", "y_hit"))


@query("j1_points", SQL_P + " SELECT event, layer, tower, x, y, x_price, y_price FROM p")
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_points(spark, sf_dir).select("event", "layer", "tower", "x", "y", "x_price", "y_price")


@query("j2_points_near", SQL_EP + ", d AS (SELECT *, (x - 768) * (x - 768) + (y - 768) * (y - 768) AS d2 FROM p) SELECT event, layer, id, d2, row_number() OVER (PARTITION BY event ORDER BY d2, id) AS rank FROM d WHERE d2 <= 90000")
def points_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = user_points(spark, sf_dir).withColumn("d2", (F.col("x") - 768) * (F.col("x") - 768) + (F.col("y") - 768) * (F.col("y") - 768)).filter("d2 <= 90000")
    return near.select("event", "layer", "id", "d2", F.row_number().over(Window.partitionBy("event").orderBy("d2", "id")).cast("long").alias("rank"))


SQL_LINKS = """, k AS (SELECT t.event, t.layer AS top_layer, b.layer AS bot_layer, t.layer - b.layer AS step, t.id AS top_id, b.id AS bot_id, t.x AS top_x, t.y AS top_y, b.x AS bot_x, b.y AS bot_y
  FROM p t JOIN p b ON t.event = b.event AND t.layer - b.layer BETWEEN 1 AND {steps} WHERE {band})"""
BAND = "(t.x - b.x) * (t.x - b.x) + (t.y - b.y) * (t.y - b.y) <= 250000"


def user_links(spark: SparkSession, sf_dir: str, skip: int) -> DataFrame:
    dx, dy = F.col("top_x") - F.col("bot_x"), F.col("top_y") - F.col("bot_y")
    return lnk.links(user_points(spark, sf_dir), skip, dx * dx + dy * dy <= 250000)


@query("j3_adjacent_links", SQL_EP + SQL_LINKS.format(steps=1, band=BAND) + " SELECT event, count(*) AS n_links, round(avg(sqrt((top_x - bot_x) ** 2 + (top_y - bot_y) ** 2)), 6) AS mean_distance, max((top_x - bot_x) * (top_x - bot_x) + (top_y - bot_y) * (top_y - bot_y)) AS most_d2 FROM k GROUP BY event")
def adjacent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d2 = (F.col("top_x") - F.col("bot_x")) * (F.col("top_x") - F.col("bot_x")) + (F.col("top_y") - F.col("bot_y")) * (F.col("top_y") - F.col("bot_y"))
    return user_links(spark, sf_dir, 0).groupBy("event").agg(F.count("*").alias("n_links"), F.round(F.avg(lnk.transverse()), 6).alias("mean_distance"), F.max(d2).alias("most_d2"))


@query("s2_stored_points", SQL_EP + SQL_LINKS.format(steps=1, band=BAND) + " SELECT event, top_layer, count(*) AS n_links FROM k GROUP BY ALL")
def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as a table bucketed by event (S2), and its links by layer. The exchange by event is that of the sink."""
    points = store.save(user_points(spark, sf_dir), f"points_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")), ("layer",))
    dx, dy = F.col("top_x") - F.col("bot_x"), F.col("top_y") - F.col("bot_y")
    return lnk.links(points, 0, dx * dx + dy * dy <= 250000).groupBy("event", "top_layer").agg(F.count("*").alias("n_links"))


@query("j3_skip_links", SQL_EP + SQL_LINKS.format(steps=4, band=BAND) + " SELECT event, step::INT AS step, count(*) AS n_links, sum(top_x - bot_x)::BIGINT AS sum_dx, sum(top_y - bot_y)::BIGINT AS sum_dy FROM k GROUP BY ALL")
def skip_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_links(spark, sf_dir, 3).groupBy("event", "step").agg(F.count("*").alias("n_links"), F.sum(F.col("top_x") - F.col("bot_x")).alias("sum_dx"), F.sum(F.col("top_y") - F.col("bot_y")).alias("sum_dy"))


SQL_LADDER = SQL_EP + SQL_LINKS.format(steps=3, band=BAND) + """,
m AS (SELECT k.*, unnest(generate_series(1, step - 1)) AS s FROM k WHERE step > 1),
mid AS (SELECT *, top_layer - s AS layer, top_x + (bot_x - top_x) * s / step AS px, top_y + (bot_y - top_y) * s / step AS py FROM m),
near AS (SELECT mid.event, top_id, bot_id, step, s, px, py, min((p.x - px) ** 2 + (p.y - py) ** 2) AS d2 FROM mid LEFT JOIN p ON mid.event = p.event AND mid.layer = p.layer GROUP BY ALL),
c AS (SELECT *, CASE WHEN px < 40 OR px > 1496 THEN 1 WHEN py % 384 < 8 THEN 2 WHEN step > 3 THEN -1 WHEN d2 <= 2500 THEN -2 WHEN d2 IS NULL THEN 4 ELSE -4 END AS code FROM near)
SELECT event, top_id, bot_id, step::INT AS step, bool_and(code > 0) AS accepted, bit_or(CASE WHEN code > 0 THEN code ELSE 0 END)::INT AS accept_bits FROM c GROUP BY event, top_id, bot_id, step"""


@query("j4_gap_ladder", SQL_LADDER)
def gap_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipping links stay only if each skipped layer explains its missing hit: an ordered list of reasons, first match wins."""
    k = user_links(spark, sf_dir, 2).filter("step > 1").withColumn("s", F.explode(F.expr("sequence(1, step - 1)")))
    share = F.col("s") / F.col("step")
    mid = k.withColumn("layer", F.col("top_layer") - F.col("s")).withColumn("px", F.col("top_x") + (F.col("bot_x") - F.col("top_x")) * F.col("s") / F.col("step")).withColumn("py", F.col("top_y") + (F.col("bot_y") - F.col("top_y")) * F.col("s") / F.col("step"))
    p = user_points(spark, sf_dir).select("event", "layer", "x", "y")
    near = mid.join(p, ["event", "layer"], "left").groupBy("event", "top_id", "bot_id", "step", "s", "px", "py").agg(F.min((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2).alias("d2"))
    code = F.when((F.col("px") < 40) | (F.col("px") > 1496), 1).when(F.col("py") % 384 < 8, 2).when(F.col("step") > 3, -1).when(F.col("d2") <= 2500, -2).when(F.col("d2").isNull(), 4).otherwise(-4)
    return near.withColumn("code", code).groupBy("event", "top_id", "bot_id", "step").agg(F.expr("bool_and(code > 0)").alias("accepted"), F.expr("bit_or(CASE WHEN code > 0 THEN code ELSE 0 END)").alias("accept_bits"))


@query("j5_nearest_point", SQL_EP + ", q AS (SELECT a.event, a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.event = b.event AND a.layer = b.layer AND a.id <> b.id) SELECT event, id, other, d2, n_near FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n_near, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS r FROM q WHERE d2 <= 160000) WHERE r = 1")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = user_points(spark, sf_dir)
    a, b = p.select("event", "layer", "id", "x", "y"), p.select("event", "layer", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return pts.nearest(a, b, ["event", "layer"], d2, (F.col("distance") <= 160000) & (F.col("id") != F.col("other")), ["other"], ["id"]).select("event", "id", "other", F.col("distance").alias("d2"), "n_near")


@query("j6_nearest_outside", SQL_EP + ", q AS (SELECT a.event, a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.event = b.event AND a.layer = b.layer + 1) SELECT event, id, other, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS r FROM q WHERE d2 > 10000) WHERE r = 1")
def nearest_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest point of the next layer outside an exclusion radius: all predicates first, then rank."""
    p = user_points(spark, sf_dir)
    a = p.select("event", F.col("layer").alias("at"), "id", "x", "y")
    b = p.select("event", (F.col("layer") + 1).alias("at"), F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return pts.nearest(a, b, ["event", "at"], d2, F.col("distance") > 10000, ["other"], ["id"]).select("event", "id", "other", F.col("distance").alias("d2"))


KINK = "atan2((u.top_x - u.bot_x)::DOUBLE, 100.0) - atan2((w.top_x - w.bot_x)::DOUBLE, 100.0)"


@query("j8_kink_chains", SQL_EP + SQL_LINKS.format(steps=1, band=BAND) + f" SELECT u.event, count(*) AS n_chains, count(*) FILTER (abs({KINK}) < 0.8) AS n_straight, round(max(abs({KINK})), 6) AS most_kink FROM k u JOIN k w ON u.event = w.event AND u.bot_id = w.top_id GROUP BY u.event")
def kink_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that share a point, with the kink between them."""
    return kinks(user_links(spark, sf_dir, 0))


def kinks(links_: DataFrame) -> DataFrame:
    pairs = lnk.chains(links_)
    slope = lambda s: F.atan2((F.col(f"{s}_top_x") - F.col(f"{s}_bot_x")).cast("double"), F.lit(100.0))
    pairs = pairs.withColumn("kink", F.abs(slope("u") - slope("w")))
    return pairs.groupBy("event").agg(F.count("*").alias("n_chains"), F.count(F.when(F.col("kink") < 0.8, 1)).alias("n_straight"), F.round(F.max("kink"), 6).alias("most_kink"))


@query("j9_plane_links", f"{E} SELECT a.event, a.view, a.layer AS top_layer, count(*) AS n_links, min(abs(a.strip - b.strip)) AS least_shift FROM e a JOIN e b ON a.event = b.event AND a.view = b.view AND a.layer = b.layer + 1 WHERE abs(a.strip - b.strip) < 580 GROUP BY ALL")
def plane_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_hits(spark, sf_dir)
    a, b = e.select("event", "view", F.col("layer").alias("top_layer"), "strip"), e.select("event", "view", (F.col("layer") + 1).alias("top_layer"), F.col("strip").alias("below"))
    shift = F.abs(F.col("strip") - F.col("below"))
    return a.join(b, ["event", "view", "top_layer"]).filter(shift < 580).groupBy("event", "view", "top_layer").agg(F.count("*").alias("n_links"), F.min(shift).alias("least_shift"))


@query("j14_shared_hits", "SELECT a.l_orderkey AS first_track, b.l_orderkey AS second_track, count(*) AS n_shared FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey GROUP BY ALL")
def shared_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks (orders) that share clusters (a part from a supplier)."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    a, b = t.withColumnRenamed("l_orderkey", "first_track"), t.withColumnRenamed("l_orderkey", "second_track")
    return a.join(b, ["l_partkey", "l_suppkey"]).filter("first_track < second_track").groupBy("first_track", "second_track").agg(F.count("*").alias("n_shared"))


@query("j15_truth_in_time", "SELECT user_id AS particle, event_id AS hit, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS turn FROM events")
def truth_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("particle"), F.col("event_id").alias("hit"), "event_type", F.row_number().over(w).cast("long").alias("turn"))


@query("j16_best_truth", "SELECT event, particle, n_shared FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY n_shared DESC, particle) AS r FROM (SELECT l_orderkey AS event, l_suppkey AS particle, count(*) AS n_shared FROM lineitem GROUP BY ALL)) WHERE r = 1")
def best_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("particle")).agg(F.count("*").alias("n"))
    return n.groupBy("event").agg(F.max(F.struct("n", (-F.col("particle")).alias("p"))).alias("best")).select("event", (-F.col("best.p")).alias("particle"), F.col("best.n").alias("n_shared"))


@query("a1_layer_statistics", SQL_EP + ", n AS (SELECT event, layer, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT a.event, sum(a.n * b.n) AS n_links FROM n a JOIN n b ON a.event = b.event AND a.layer - b.layer BETWEEN 1 AND 4 GROUP BY a.event) SELECT n.event, sum(n.n)::BIGINT AS n_points, count(*) AS n_layers, coalesce(max(k.n_links), 0)::BIGINT AS n_links FROM n LEFT JOIN k USING (event) GROUP BY n.event")
def layer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.layer_statistics(user_points(spark, sf_dir), 3)


@query("s6_order_key", f"{L} SELECT event, view + 2 * layer + 64 * tower AS sort_key, count(*) AS n_hits FROM l GROUP BY ALL")
def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_hits(spark, sf_dir).groupBy("event", order_key(F.col("tower"), F.col("layer"), F.col("view")).alias("sort_key")).agg(F.count("*").alias("n_hits"))


SQL_PATHS = SQL_EP + SQL_LINKS.format(steps=1, band=BAND) + """, s AS (SELECT event, top_id AS a, bot_id AS b FROM k),
r AS (SELECT event, a AS head, b AS tail, 1 AS n FROM s UNION ALL SELECT r.event, r.head, s.b, r.n + 1 FROM r JOIN s ON r.event = s.event AND r.tail = s.a)
SELECT event, head, n AS n_links, count(*) AS n_paths FROM r WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM s WHERE s.event = r.event AND s.a = r.tail) GROUP BY ALL"""


@query("t4_paths", SQL_PATHS.replace("WITH ", "WITH RECURSIVE ", 1))
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of links down to their dead ends, over at most 17 layer steps."""
    return lnk.paths(user_links(spark, sf_dir, 0), 17).groupBy("event", "head", "n_links").agg(F.count("*").alias("n_paths"))


@query("t4_all_paths", (SQL_EP + SQL_LINKS.format(steps=1, band=BAND) + SQL_PATHS[SQL_PATHS.index(", s AS (") :]).replace("WITH ", "WITH RECURSIVE ", 1))
def all_adjacent_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of t4_paths, which takes all links too by now."""
    return lnk.paths(user_links(spark, sf_dir, 0), 17).groupBy("event", "head", "n_links").agg(F.count("*").alias("n_paths"))


@query("j8_all_kink_chains", SQL_EP + SQL_LINKS.format(steps=1, band=BAND) + f" SELECT u.event, count(*) AS n_chains, count(*) FILTER (abs({KINK}) < 0.8) AS n_straight, round(max(abs({KINK})), 6) AS most_kink FROM k u JOIN k w ON u.event = w.event AND u.bot_id = w.top_id GROUP BY u.event")
def all_kink_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of j8_kink_chains, which takes all links too by now."""
    return kinks(user_links(spark, sf_dir, 0))
