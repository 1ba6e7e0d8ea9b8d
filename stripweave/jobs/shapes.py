"""Queries on shapes of point sets: bin parameters and clusters, forests, trimmed moments, link gates, residuals, candidate sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import axes, candidates, density, moments
from ..operators import links as lnk
from ..sources.hits import SQL_POINTS, SQL_USERS, label_points, table, user_hits
from .hits import BAND, SQL_EP, SQL_LINKS, user_links, user_points
from .register import query

V = f"WITH {SQL_POINTS}"
LINKED = SQL_EP + SQL_LINKS.format(steps=1, band=BAND)


@query(
    "a4_bin_parameters",
    f"""{LINKED}, n AS (SELECT event, count(*) AS n FROM k GROUP BY event),
d AS (SELECT event, n, greatest(1, least(6, floor(log10(n) + 0.5)))::INT AS decade FROM n)
SELECT event, n, ([15.0, 15.0, 12.0, 12.0, 10.0, 20.0])[decade]::DOUBLE AS bin_size, ([8, 6, 6, 5, 4, 2])[decade]::INT AS separation, ([2, 3, 5, 8, 10, 10])[decade]::INT AS least_points FROM d""",
)
def bin_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = user_links(spark, sf_dir, 0).groupBy("event").agg(F.count("*").alias("n"))
    size, separation, least = density.bin_parameters(F.col("n"))
    return n.select("event", "n", size.alias("bin_size"), separation.alias("separation"), least.alias("least_points"))


SQL_BINS = f"""{V.replace("WITH", "WITH RECURSIVE", 1)},
b AS MATERIALIZED (SELECT grp, floor((x + 0.05) / 0.1)::INT AS bx, floor((y + 0.05) / 0.1)::INT AS by_, floor((z + 0.05) / 0.1)::INT AS bz, count(*) AS n, bit_or((1 << (id % 18))::INT)::INT AS layers FROM v GROUP BY ALL)"""


def point_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moments.bins(label_points(spark, sf_dir), 0.1).withColumn("bit", F.expr("shiftleft(1, int(id % 18))"))
    return rows.groupBy("grp", "bx", F.col("by").alias("by_"), "bz").agg(F.count("*").alias("n"), F.expr("bit_or(bit)").alias("layers"))


SQL_CLUSTERS = f"""{SQL_BINS},
i AS MATERIALIZED (SELECT *, grp || ':' || bx || ':' || by_ || ':' || bz AS id FROM b),
q AS MATERIALIZED (SELECT a.id, o.id AS other, o.n AS m FROM i a JOIN i o ON a.grp = o.grp AND a.id <> o.id AND abs(a.bx - o.bx) < 2 AND abs(a.by_ - o.by_) < 2 AND abs(a.bz - o.bz) < 2),
c AS MATERIALIZED (SELECT i.id FROM i LEFT JOIN (SELECT id, sum(m) AS around FROM q GROUP BY id) r USING (id) WHERE NOT (coalesce(around, 0) < 3 AND bit_count(layers) < 2)),
e AS MATERIALIZED (SELECT id, other FROM q WHERE id IN (SELECT id FROM c) AND other IN (SELECT id FROM c)),
w AS (SELECT id, id AS seen FROM c UNION SELECT w.id, e.other FROM w JOIN e ON w.seen = e.id),
l AS (SELECT id, min(seen) AS label FROM w GROUP BY id)
SELECT i.grp, i.bx, i.by_, i.bz, i.n, l.label FROM i LEFT JOIN l USING (id)"""


@query("g1_bin_clusters", SQL_CLUSTERS)
def bin_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of accumulator bins: touching bins, less the noise."""
    return density.bin_clusters(point_bins(spark, sf_dir), 2, 3).select("grp", "bx", "by_", "bz", "n", "label")


@query(
    "a12_density_moments",
    f"""{V}, b AS (SELECT *, floor((x + 0.05) / 0.1)::INT AS bx, floor((y + 0.05) / 0.1)::INT AS by_, floor((z + 0.05) / 0.1)::INT AS bz FROM v),
w AS (SELECT *, count(*) OVER (PARTITION BY grp, bx, by_, bz)::DOUBLE AS w FROM b)
SELECT grp, count(*) AS n, sum(w) AS w, round(sum(w * x) / sum(w), 6) AS mx, round(sum(w * y) / sum(w), 6) AS my, round(sum(w * z) / sum(w), 6) AS mz,
 round(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2, 6) AS cxx, round(sum(w * z * z) / sum(w) - (sum(w * z) / sum(w)) ** 2, 6) AS czz FROM w GROUP BY grp""",
)
def density_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each group, a point weighted by the number of points in its box."""
    boxes = point_bins(spark, sf_dir).select("grp", "bx", F.col("by_").alias("by"), "bz", F.col("n").cast("double").alias("w"))
    rows = moments.bins(label_points(spark, sf_dir), 0.1).join(boxes, ["grp", "bx", "by", "bz"])
    s = moments.scatter(rows, "grp", F.col("w"))
    return s.select("grp", "n", "w", *[F.round(c, 6).alias(c) for c in ("mx", "my", "mz", "cxx", "czz")])


@query("a6_trimmed_moments")
def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative moments of each group without its outliers."""
    return axes.trimmed_moments(label_points(spark, sf_dir)).select("grp", "n", "n_dropped", "n_rounds", "mx", "my", "mz", "ax", "ay", "az", "e1", "e2", "e3")


@query("a7_reweighted_moments")
def reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each group, its points weighted by their nearness to the axis."""
    return axes.reweighted_moments(label_points(spark, sf_dir))


def forest(spark: SparkSession, sf_dir: str, size: float = 0.25) -> tuple[DataFrame, DataFrame]:
    points = label_points(spark, sf_dir)
    return points.select("id", "grp"), density.near_forest(points, size)


@query("g4_spanning_forest")
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the lightest forest over near points of one group."""
    return forest(spark, sf_dir)[1]


@query("g5_forest_trees")
def forest_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found = forest(spark, sf_dir)
    return density.trees_of(nodes.select("id"), found).groupBy("label", "size").agg(F.max("rank").alias("rank"))


@query("g7_cut_trees")
def cut_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees after their long edges are cut, by size."""
    nodes, found = forest(spark, sf_dir)
    label = density.trees_of(nodes.select("id"), found).select(F.col("id").alias("a"), F.col("label").alias("tree"))
    left = density.cut_forest(found.join(label, "a"), 1.5, 0.05)
    return density.trees_of(nodes.select("id"), left).groupBy("label", "size").agg(F.max("rank").alias("rank"))


SQL_GATES = f"""{LINKED}, c AS (SELECT event, avg(x * 0.228::DOUBLE) AS cx, avg(y * 0.228::DOUBLE) AS cy, avg(layer * 32.575::DOUBLE) AS cz FROM p GROUP BY event),
d AS (SELECT k.event, (top_x - bot_x) * 0.228::DOUBLE AS dx, (top_y - bot_y) * 0.228::DOUBLE AS dy, step * 32.575::DOUBLE AS dz, cx - top_x * 0.228::DOUBLE AS wx, cy - top_y * 0.228::DOUBLE AS wy, cz - top_layer * 32.575::DOUBLE AS wz FROM k JOIN c ON k.event = c.event),
a AS (SELECT event, round(sqrt((wy * dz - wz * dy) ** 2 + (wz * dx - wx * dz) ** 2 + (wx * dy - wy * dx) ** 2) / sqrt(dx * dx + dy * dy + dz * dz), 6) AS doca FROM d)
SELECT event, count(*) AS n_links, count(*) FILTER (doca <= 150) AS n_kept, count(*) FILTER (doca < 30) AS n_tight, min(doca) AS least_doca FROM a GROUP BY event"""


@query("j3b_link_gates", SQL_GATES)
def link_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest approach of each link to its event's position (here the points' centroid): those inside the tolerance stay, those inside the tight one are marked."""
    p = user_points(spark, sf_dir)
    mm = {"x": F.col("x") * geo.STRIP_PITCH, "y": F.col("y") * geo.STRIP_PITCH, "z": F.col("layer") * geo.LAYER_PITCH}
    position = p.groupBy("event").agg(*[F.avg(v).alias(f"c{k}") for k, v in mm.items()])
    a = lnk.gated(user_links(spark, sf_dir, 0), position, 150.0, 30.0)
    kept = F.count(F.when(F.col("kept"), 1)).alias("n_kept")
    return a.groupBy("event").agg(F.count("*").alias("n_links"), kept, F.count(F.when(F.col("tight"), 1)).alias("n_tight"), F.min("doca").alias("least_doca"))


SQL_RESIDUALS = f"""WITH {SQL_USERS}, m AS (SELECT event, view, layer::DOUBLE AS z, avg(strip)::DOUBLE AS y FROM e GROUP BY ALL),
s AS (SELECT event, view, count(*) AS n, avg(z) AS mz, avg(y) AS my, sum(z * z) - sum(z) * sum(z) / count(*) AS szz, sum(z * y) - sum(z) * sum(y) / count(*) AS szy FROM m GROUP BY ALL)
SELECT m.event, m.view, m.z::INT AS layer, round((y - my - szy / szz * (z - mz)) / (1 - 1.0::DOUBLE / n - (z - mz) * (z - mz) / szz), 4) AS residual FROM m JOIN s USING (event, view) WHERE n >= 4"""


@query("k9_leave_one_out", SQL_RESIDUALS)
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual of each plane from the line through the others (no scattering), by its leverage instead of a fit for each."""
    m = user_hits(spark, sf_dir).groupBy("event", "view", F.col("layer").cast("double").alias("z")).agg(F.avg("strip").alias("y"))
    return moments.leave_one_out(m, ["event", "view"], 4).select("event", "view", F.col("z").cast("int").alias("layer"), F.round("residual", 4).alias("residual"))


ERF = "1 - (0.34802 - (0.09587 - 0.74785 / (1 + 0.47047 * a)) / (1 + 0.47047 * a)) / (1 + 0.47047 * a) * exp(-a * a)"


@query("m10_threshold", f"SELECT l_orderkey, l_linenumber, round(CASE WHEN x < 0 THEN 0.5 * (1 + f) ELSE 0.5 * (1 - f) END, 6)::DOUBLE AS threshold FROM (SELECT *, {ERF} AS f FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25.0) / 10 AS x, abs((l_quantity - 25.0) / 10)::DOUBLE AS a FROM lineitem))")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_quantity").cast("double") - 25.0) / 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(geo.threshold(x), 6).alias("threshold"))


@query("p5_candidate_set")
def candidate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates (orders) of an event (customer) by value, without those whose hits (parts) others have taken."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("candidate")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("hits"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").cast("double").alias("quality"))
    return candidates.candidate_set(orders.join(parts, "candidate"))
