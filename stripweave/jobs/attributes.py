"""Queries on attributes of links, planes, candidates and vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import moments
from ..sources.hits import SQL_ORDERS, SQL_POINTS, SQL_USERS, label_points, order_hits, table, user_hits
from .hits import BAND, SQL_EP, SQL_ISLANDS, SQL_LINKS, clusters, user_links
from .register import query

L, E, V = f"WITH {SQL_ORDERS}", f"WITH {SQL_USERS}", f"WITH {SQL_POINTS}"
#: Made-up values that grow with the width: error of a cluster of 1 to 8 strips, in strip pitches.
WIDTH_ERRORS = (0.27, 0.33, 0.4, 0.5, 0.62, 0.75, 0.9, 1.05)
ADJACENT = SQL_EP + SQL_LINKS.format(steps=1, band=BAND)


@query("s5_truth_of_clusters", SQL_ISLANDS + ", c AS (SELECT event, view, island::BIGINT AS island, min(strip) AS lo, max(strip + width - 1) AS hi FROM i GROUP BY ALL) SELECT c.event, c.view, c.island, count(DISTINCT l.part) AS n_particles FROM c JOIN l ON l.event = c.event AND l.view = c.view AND l.strip + 1 BETWEEN c.lo AND c.hi GROUP BY ALL")
def truth_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth labels narrowed to the clusters whose strips hold them, each particle once."""
    c = clusters(spark, sf_dir).groupBy("event", "view", "island").agg(F.min("strip").alias("lo"), F.max("last_strip").alias("hi"))
    labels = order_hits(spark, sf_dir).select("event", "view", "part", (F.col("strip") + 1).alias("label"))
    return c.join(labels, ["event", "view"]).filter("label BETWEEN lo AND hi").groupBy("event", "view", "island").agg(F.countDistinct("part").alias("n_particles"))


@query("s8_link_segments", ADJACENT + " SELECT event, top_id, bot_id, round(top_x * 0.228, 4)::DOUBLE AS x0, round(top_y * 0.228, 4)::DOUBLE AS y0, round(top_layer * 32.575, 4)::DOUBLE AS z0, round(bot_x * 0.228, 4)::DOUBLE AS x1, round(bot_y * 0.228, 4)::DOUBLE AS y1, round(bot_layer * 32.575, 4)::DOUBLE AS z1 FROM k")
def link_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line segments in millimetres, for any display."""
    mm = lambda c, size: F.round(F.col(c) * size, 4)
    cols = [mm(f"{e}_{a}", s).alias(f"{a}{i}") for i, e in enumerate(("top", "bot")) for a, s in (("x", geo.STRIP_PITCH), ("y", geo.STRIP_PITCH))]
    return user_links(spark, sf_dir, 0).select("event", "top_id", "bot_id", *cols, mm("top_layer", geo.LAYER_PITCH).alias("z0"), mm("bot_layer", geo.LAYER_PITCH).alias("z1"))


@query("j3c_link_attributes", SQL_EP + SQL_LINKS.format(steps=3, band=BAND) + ", a AS (SELECT *, sqrt(((top_x-bot_x)**2 + (top_y-bot_y)**2) * 0.228**2 + (step * 32.575)**2) AS len FROM k) SELECT event, top_id, bot_id, round(least(0.114, 2 * greatest(3 * 0.228 / len, 13.6 * sqrt(0.03 * step) * (1 + 0.038 * ln(0.03 * step)) / 100)), 6) AS most_angle, (1 << (step - 1)::INT)::INT AS skip_bits FROM a")
def link_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.sqrt((((F.col("top_x") - F.col("bot_x")) ** 2 + (F.col("top_y") - F.col("bot_y")) ** 2) * geo.STRIP_PITCH**2) + (F.col("step") * geo.LAYER_PITCH) ** 2)
    angle = F.least(F.lit(geo.STRIP_PITCH / 2), 2 * F.greatest(3 * geo.STRIP_PITCH / size, geo.scattering(0.03 * F.col("step"), F.lit(100))))
    return user_links(spark, sf_dir, 2).select("event", "top_id", "bot_id", F.round(angle, 6).alias("most_angle"), F.expr("shiftleft(1, step - 1)").alias("skip_bits"))


SQL_BINS = f"""{V}, b AS (SELECT grp, floor((x + 0.05) / 0.1)::INT AS bx, floor((y + 0.05) / 0.1)::INT AS by_, floor((z + 0.05) / 0.1)::INT AS bz, count(*) AS n, bit_count(bit_or((1 << (id % 18))::INT))::INT AS layers, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY layers DESC, n DESC, bx, by_, bz) AS rank FROM b)"""


def ranked_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moments.bins(label_points(spark, sf_dir), 0.1).withColumn("bit", F.expr("shiftleft(1, int(id % 18))"))
    b = rows.groupBy("grp", "bx", F.col("by").alias("by_"), "bz").agg(F.count("*").alias("n"), F.bit_count(F.expr("bit_or(bit)")).alias("layers"), *[F.avg(a).alias(f"m{a}") for a in "xyz"])
    return b.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("layers"), F.desc("n"), "bx", "by_", "bz")).cast("long"))


@query("g2_ranked_bins", SQL_BINS + " SELECT grp, rank, bx, by_, bz, n, layers FROM r WHERE rank <= 6")
def best_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_bins(spark, sf_dir).filter("rank <= 6").select("grp", "rank", "bx", "by_", "bz", "n", "layers")


@query("g3_absorbed_points", SQL_BINS + " SELECT v.grp, count(*) AS n_near, min(v.id) AS first_id FROM v JOIN r ON r.grp = v.grp AND r.rank = 1 WHERE round((x-mx)**2 + (y-my)**2 + (z-mz)**2, 9) <= 0.04 GROUP BY v.grp HAVING count(*) >= 3")
def absorbed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = ranked_bins(spark, sf_dir).filter("rank = 1").select("grp", "mx", "my", "mz")
    d2 = F.round((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 + (F.col("z") - F.col("mz")) ** 2, 9)
    return label_points(spark, sf_dir).join(peak, "grp").filter(d2 <= 0.04).groupBy("grp").agg(F.count("*").alias("n_near"), F.min("id").alias("first_id")).filter("n_near >= 3")


SQL_D2 = "(top_x-bot_x)*(top_x-bot_x) + (top_y-bot_y)*(top_y-bot_y)"


@query("t1_best_parents", ADJACENT + f", b AS (SELECT *, row_number() OVER (PARTITION BY bot_id ORDER BY {SQL_D2}, top_id) AS r FROM k) SELECT event, top_id AS parent_id, count(*) AS n_children, min(bot_id) AS first_child FROM b WHERE r = 1 GROUP BY ALL")
def best_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point hangs on its nearest upper point; nodes with their number of children; t1_growth grows whole trees."""
    d2 = (F.col("top_x") - F.col("bot_x")) * (F.col("top_x") - F.col("bot_x")) + (F.col("top_y") - F.col("bot_y")) * (F.col("top_y") - F.col("bot_y"))
    best = user_links(spark, sf_dir, 0).withColumn("r", F.row_number().over(Window.partitionBy("bot_id").orderBy(d2, "top_id"))).filter("r = 1")
    return best.groupBy("event", F.col("top_id").alias("parent_id")).agg(F.count("*").alias("n_children"), F.min("bot_id").alias("first_child"))


@query("t6_pruned_branches", ADJACENT + f", d AS (SELECT *, (top_x-bot_x)*0.228 AS dx, (top_y-bot_y)*0.228 AS dy FROM k), f AS (SELECT *, first_value(dx) OVER w AS fx, first_value(dy) OVER w AS fy FROM d WINDOW w AS (PARTITION BY top_id ORDER BY {SQL_D2}, bot_id)) SELECT event, top_id, count(*) AS n_all, count(*) FILTER (round((dx*fx + dy*fy + 32.575**2) / sqrt(dx*dx + dy*dy + 32.575**2) / sqrt(fx*fx + fy*fy + 32.575**2), 9) >= 0.975) AS n_kept FROM f GROUP BY ALL")
def pruned_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each node's branches those within a cosine of 0.975 of the best one stay."""
    k = user_links(spark, sf_dir, 0)
    d2 = (F.col("top_x") - F.col("bot_x")) * (F.col("top_x") - F.col("bot_x")) + (F.col("top_y") - F.col("bot_y")) * (F.col("top_y") - F.col("bot_y"))
    d = k.withColumn("dx", (F.col("top_x") - F.col("bot_x")) * geo.STRIP_PITCH).withColumn("dy", (F.col("top_y") - F.col("bot_y")) * geo.STRIP_PITCH)
    w = Window.partitionBy("top_id").orderBy(d2, "bot_id")
    f = d.withColumn("fx", F.first("dx").over(w)).withColumn("fy", F.first("dy").over(w))
    zz = geo.LAYER_PITCH**2
    cosine = (F.col("dx") * F.col("fx") + F.col("dy") * F.col("fy") + zz) / F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + zz) / F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy") + zz)
    return f.groupBy("event", "top_id").agg(F.count("*").alias("n_all"), F.count(F.when(F.round(cosine, 9) >= 0.975, 1)).alias("n_kept"))


@query("t7_head_points", ADJACENT + " SELECT DISTINCT event, top_id AS head, top_layer AS layer FROM k WHERE top_id NOT IN (SELECT bot_id FROM k)")
def head_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = user_links(spark, sf_dir, 0)
    heads = k.select("event", F.col("top_id").alias("head"), F.col("top_layer").alias("layer")).distinct()
    return heads.join(k.select("event", F.col("bot_id").alias("head")), ["event", "head"], "left_anti")


@query("t11_best_of_two_seeds", "SELECT o_custkey AS event, min(o_orderkey) AS first_track, CASE WHEN max(o_totalprice) / min(o_totalprice) > 2 AND min(o_totalprice) < 50000 THEN arg_min(o_orderkey, (o_totalprice, o_orderkey)) ELSE arg_max(o_orderkey, (o_totalprice, -o_orderkey)) END AS chosen FROM orders GROUP BY o_custkey")
def best_of_two_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event")).agg(F.min("o_orderkey").alias("first_track"), F.min(F.struct("o_totalprice", "o_orderkey")).alias("low"), F.max(F.struct(F.col("o_totalprice"), (-F.col("o_orderkey")).alias("k"))).alias("high"))
    narrow = (F.col("high.o_totalprice") / F.col("low.o_totalprice") > 2) & (F.col("low.o_totalprice") < 50000)
    return o.select("event", "first_track", F.when(narrow, F.col("low.o_orderkey")).otherwise(-F.col("high.k")).alias("chosen"))


@query("p8_candidate_quality", "SELECT o_orderkey AS track, round(64.0 * least(8, n) / 16 - 1.5 * disc - 7 * abs(lay - 4) - 4 * (n > 5)::INT, 4) AS quality FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, max(l_discount) AS disc, max(l_linenumber) AS lay FROM lineitem GROUP BY l_orderkey)")
def candidate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(F.count("*").alias("n"), F.max("l_discount").alias("disc"), F.max("l_linenumber").alias("lay"))
    q = 64.0 * F.least(F.lit(8), F.col("n")) / 16 - 1.5 * F.col("disc") - 7 * F.abs(F.col("lay") - 4) - 4 * (F.col("n") > 5).cast("int")
    return t.select("track", F.round(q, 4).alias("quality"))


@query("p9_predicted_radius", f"{V}, c AS (SELECT grp, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY grp) SELECT grp, layer::INT AS layer, round(cx + (layer * 32.575) * 0.01, 5) AS px, round(cy - (layer * 32.575) * 0.02, 5) AS py, round(0.1 * (layer * 32.575 + 50), 4)::DOUBLE AS radius FROM c, range(0, 18) t(layer)")
def predicted_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and radius of the calorimeter's prediction on each of the 18 layers."""
    c = label_points(spark, sf_dir).groupBy("grp").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(17))))
    z = F.col("layer") * geo.LAYER_PITCH
    return c.select("grp", "layer", F.round(F.col("cx") + z * 0.01, 5).alias("px"), F.round(F.col("cy") - z * 0.02, 5).alias("py"), F.round(0.1 * (z + 50), 4).alias("radius"))


@query("h2_next_plane", f"{L}, n AS (SELECT *, strip + (price % 200 - 100) * 3 AS ahead FROM l) SELECT event, price, 2 * (layer - 1) + (1 - view) AS next_plane, ahead AS predicted, floor(ahead / 384.0)::INT <> floor(strip / 384.0)::INT AS crosses FROM n WHERE layer > 1")
def next_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_hits(spark, sf_dir).filter("layer > 1").withColumn("ahead", F.col("strip") + (F.col("price") % 200 - 100) * 3)
    return n.select("event", "price", geo.plane(F.col("layer") - 1, 1 - F.col("view")).alias("next_plane"), F.col("ahead").alias("predicted"), (F.floor(F.col("ahead") / 384.0) != F.floor(F.col("strip") / 384.0)).alias("crosses"))


@query("h4_accepted_clusters", f"{L}, q AS (SELECT a.event, a.price, b.price AS found, abs(a.strip - b.strip) AS off, row_number() OVER (PARTITION BY a.event, a.layer, a.price, a.part, a.supp ORDER BY abs(a.strip - b.strip), b.price, b.part, b.supp) AS r FROM l a JOIN l b ON a.event = b.event AND a.view = b.view AND b.layer = a.layer - 1 WHERE abs(a.strip - b.strip) <= 9 * 40 AND b.width >= a.width - 1) SELECT event, price, found, off FROM q WHERE r = 1")
def accepted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest cluster of the next layer inside nine sigma that is wide enough."""
    a = order_hits(spark, sf_dir).withColumn("at", F.col("layer") - 1)
    b = order_hits(spark, sf_dir).select("event", "view", F.col("layer").alias("at"), F.col("strip").alias("s2"), F.col("width").alias("w2"), F.col("price").alias("found"), F.col("part").alias("part2"), F.col("supp").alias("supp2"))
    off = F.abs(F.col("strip") - F.col("s2"))
    q = a.join(b, ["event", "view", "at"]).withColumn("off", off).filter("off <= 360 AND w2 >= width - 1")
    w = Window.partitionBy("event", "layer", "price", "part", "supp").orderBy("off", "found", "part2", "supp2")
    return q.withColumn("r", F.row_number().over(w)).filter("r = 1").select("event", "price", "found", "off")


@query("m2_process_noise", f"{L} SELECT event, price, round(t2 * 32.575 ** 2 / 3, 9) AS q11, round(t2 * 32.575 / 2, 9) AS q12, round(t2, 9) AS q22 FROM (SELECT *, (13.6 * sqrt(0.03 * width) * (1 + 0.038 * ln(0.03 * width)) / 100) ** 2 AS t2 FROM l)")
def process_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_hits(spark, sf_dir).withColumn("t2", geo.scattering(0.03 * F.col("width"), F.lit(100)) ** 2)
    return rows.select("event", "price", F.round(F.col("t2") * geo.LAYER_PITCH**2 / 3, 9).alias("q11"), F.round(F.col("t2") * geo.LAYER_PITCH / 2, 9).alias("q12"), F.round("t2", 9).alias("q22"))


@query("m3_measured_errors", f"{L} SELECT event, price, round(0.228 * [0.27, 0.33, 0.4, 0.5, 0.62, 0.75, 0.9, 1.05][width] * sqrt(1 + ((strip - 768) / 768.0) ** 2), 6) AS slope_corrected, round(0.228 * width / sqrt(12), 6) AS by_width FROM l")
def measured_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of clusters: corrected for the slope by a table of widths, and by the width alone."""
    t = F.element_at(F.array(*map(F.lit, WIDTH_ERRORS)), F.col("width"))
    return order_hits(spark, sf_dir).select("event", "price", F.round(geo.STRIP_PITCH * t * F.sqrt(1 + ((F.col("strip") - 768) / 768.0) ** 2), 6).alias("slope_corrected"), F.round(geo.STRIP_PITCH * F.col("width") / F.sqrt(F.lit(12)), 6).alias("by_width"))


@query("m5_ray_directions", ADJACENT + " SELECT event, top_id, bot_id, round((bot_x - top_x) / len, 6) AS ux, round((bot_y - top_y) / len, 6) AS uy, round(-100 / len, 6) AS uz FROM (SELECT *, sqrt((top_x-bot_x)**2 + (top_y-bot_y)**2 + 10000) AS len FROM k)")
def ray_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.sqrt((F.col("top_x") - F.col("bot_x")) ** 2 + (F.col("top_y") - F.col("bot_y")) ** 2 + 10000)
    k = user_links(spark, sf_dir, 0).withColumn("len", size)
    return k.select("event", "top_id", "bot_id", F.round((F.col("bot_x") - F.col("top_x")) / F.col("len"), 6).alias("ux"), F.round((F.col("bot_y") - F.col("top_y")) / F.col("len"), 6).alias("uy"), F.round(-100 / F.col("len"), 6).alias("uz"))


@query("m7_first_kinks", f"{E}, o AS (SELECT event, strip, row_number() OVER (PARTITION BY event, view ORDER BY layer DESC, hit) AS r, view FROM e), t AS (SELECT event, view, max(strip) FILTER (r = 1) AS a, max(strip) FILTER (r = 2) AS b, max(strip) FILTER (r = 3) AS c FROM o WHERE r <= 3 GROUP BY ALL) SELECT event, view, round(acos(least(1.0, greatest(-1.0, ((a-b) * (b-c) + 10000) / sqrt((a-b)**2 + 10000) / sqrt((b-c)**2 + 10000)))), 5) AS kink FROM t WHERE c IS NOT NULL")
def first_kinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kink of a track; the cosine is clamped to [-1, 1]."""
    w = Window.partitionBy("event", "view").orderBy(F.desc("layer"), "hit")
    o = user_hits(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r <= 3")
    t = o.groupBy("event", "view").agg(*[F.max(F.when(F.col("r") == k + 1, F.col("strip"))).alias(c) for k, c in enumerate("abc")]).filter("c IS NOT NULL")
    u, v = F.col("a") - F.col("b"), F.col("b") - F.col("c")
    cosine = (u * v + 10000) / F.sqrt(u**2 + 10000) / F.sqrt(v**2 + 10000)
    return t.select("event", "view", F.round(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))), 5).alias("kink"))


@query("n1_energy_split", "SELECT o_custkey AS event, round(total * greatest(0.5, least(0.98, first / total)), 4) AS first_energy, round(total * (1 - greatest(0.5, least(0.98, first / total))), 4) AS second_energy FROM (SELECT o_custkey, max(o_totalprice) AS first, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def energy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event")).agg(F.max("o_totalprice").alias("first"), F.sum("o_totalprice").alias("total"), F.count("*").alias("n")).filter("n > 1")
    share = F.greatest(F.lit(0.5), F.least(F.lit(0.98), F.col("first") / F.col("total")))
    return o.select("event", F.round(F.col("total") * share, 4).alias("first_energy"), F.round(F.col("total") * (1 - share), 4).alias("second_energy"))


@query("n3_classified_split", "SELECT l_orderkey AS event, l_linenumber AS track, CASE WHEN l_discount >= 0.05 THEN 0.75 ELSE 0.5 END::DOUBLE AS first_share, 10000.0::DOUBLE AS fixed_energy FROM lineitem WHERE l_linenumber <= 2")
def classified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by a classifier's probability, and the fixed-energy override beside them."""
    return table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("track"), F.when(F.col("l_discount") >= 0.05, 0.75).otherwise(0.5).alias("first_share"), F.lit(10000.0).alias("fixed_energy"))
