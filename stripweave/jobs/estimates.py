"""Queries on moments, fits, filters, and closed-form estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import kalman, moments
from ..sources.hits import SQL_ORDERS, SQL_POINTS, SQL_USERS, label_points, order_hits, user_hits
from .register import query

L, E, V = f"WITH {SQL_ORDERS}", f"WITH {SQL_USERS}", f"WITH {SQL_POINTS}"


@query("a2_mean_and_error", f"{V} SELECT grp, count(*) AS n, round(avg(x), 5) AS mean_x, round(sqrt(greatest(0.24, (avg(x * x) - avg(x) ** 2) / (count(*) - 1))), 5) AS error_x FROM v GROUP BY grp HAVING count(*) > 1")
def mean_and_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e2 = (F.avg(F.col("x") * F.col("x")) - F.avg("x") ** 2) / (F.count("*") - 1)
    return label_points(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("x"), 5).alias("mean_x"), F.round(F.sqrt(F.greatest(F.lit(0.24), e2)), 5).alias("error_x")).filter("n > 1")


@query("a3_accumulator", f"{V} SELECT grp, floor((x + 0.05) / 0.1)::INT AS bx, floor((y + 0.05) / 0.1)::INT AS by_, floor((z + 0.05) / 0.1)::INT AS bz, count(*) AS n, min(id) AS low_id, max(id) AS high_id, bit_or((1 << (id % 18))::INT)::INT AS layers, bit_count(bit_or((1 << (id % 18))::INT))::INT AS n_layers FROM v GROUP BY ALL")
def accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moments.bins(label_points(spark, sf_dir), 0.1).withColumn("bit", F.expr("shiftleft(1, int(id % 18))"))
    out = rows.groupBy("grp", "bx", F.col("by").alias("by_"), "bz").agg(F.count("*").alias("n"), F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.expr("bit_or(bit)").alias("layers"))
    return out.withColumn("n_layers", F.bit_count("layers"))


SQL_SCATTER = """, s AS (SELECT grp, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x*x) - avg(x)**2 AS cxx, avg(y*y) - avg(y)**2 AS cyy, avg(z*z) - avg(z)**2 AS czz,
 avg(x*y) - avg(x)*avg(y) AS cxy, avg(x*z) - avg(x)*avg(z) AS cxz, avg(y*z) - avg(y)*avg(z) AS cyz FROM v GROUP BY grp)"""


@query("a10_scatter", V + SQL_SCATTER + " SELECT grp, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mx", "my", "mz", "cxx", "cyy", "czz", "cxy", "cxz", "cyz")) + " FROM s")
def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = moments.scatter(label_points(spark, sf_dir), "grp")
    return s.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mx", "my", "mz", "cxx", "cyy", "czz", "cxy", "cxz", "cyz")])


SQL_PRINCIPAL = V + SQL_SCATTER + """, q AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM s), p AS (SELECT *, sqrt(((cxx-q)**2 + (cyy-q)**2 + (czz-q)**2 + 2 * (cxy**2 + cxz**2 + cyz**2)) / 6) AS p FROM q),
d AS (SELECT *, ((cxx-q) * ((cyy-q) * (czz-q) - cyz**2) - cxy * (cxy * (czz-q) - cyz * cxz) + cxz * (cxy * cyz - (cyy-q) * cxz)) / (p*p*p) AS det FROM p),
f AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1.0, least(1.0, det / 2))) / 3 ELSE 0.0 END AS phi FROM d)
SELECT grp, n, round(q + 2*p*cos(phi), 5) AS e1, round(3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3)), 5) AS e2, round(q + 2*p*cos(phi + 2*pi()/3), 5) AS e3 FROM f"""


@query("a5_principal_moments", SQL_PRINCIPAL)
def principal_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments analysis in closed form: eigenvalues of each group's scatter (A5)."""
    rows = moments.principal(moments.scatter(label_points(spark, sf_dir), "grp"))
    return rows.select("grp", "n", *[F.round(c, 5).alias(c) for c in ("e1", "e2", "e3")])


@query("a8_weighted_centroid", f"{V}, w AS (SELECT *, 1 / greatest(0.01, least(100000.0, x*x + y*y)) AS w FROM v) SELECT grp, count(*) AS n, round(sum(w * x) / sum(w), 5) AS mx, round(sum(w * y) / sum(w), 5) AS my, round(sum(w * z) / sum(w), 5) AS mz FROM w GROUP BY grp")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = 1 / F.greatest(F.lit(0.01), F.least(F.lit(100000.0), F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    s = moments.scatter(label_points(spark, sf_dir), "grp", w)
    return s.select("grp", "n", *[F.round(c, 5).alias(c) for c in ("mx", "my", "mz")])


@query("a11_bounding_boxes", f"{V}, d AS (SELECT *, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS d FROM v WINDOW w AS (PARTITION BY grp ORDER BY id)) SELECT grp, " + ", ".join(f"round(min({c}) - 0.01, 6) AS low_{c}, round(max({c}) + 0.01, 6) AS high_{c}" for c in "xyz") + ", round(avg(d), 5) AS mean_step, round(sqrt(avg(d * d)), 5) AS rms_step FROM d GROUP BY grp")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("grp").orderBy("id")
    d = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    rows = label_points(spark, sf_dir).withColumn("d", d)
    ends = [e for c in "xyz" for e in (F.round(F.min(c) - 0.01, 6).alias(f"low_{c}"), F.round(F.max(c) + 0.01, 6).alias(f"high_{c}"))]
    return rows.groupBy("grp").agg(*ends, F.round(F.avg("d"), 5).alias("mean_step"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 5).alias("rms_step"))


@query("a13_line_fits", f"{E}, s AS (SELECT event, count(*) AS n, sum(w) AS s, sum(w*z) AS sz, sum(w*y) AS sy, sum(w*z*z) AS szz, sum(w*z*y) AS szy, sum(w*y*y) AS syy FROM (SELECT event, layer::DOUBLE AS z, strip / 100.0 AS y, 1.0 / (1 + view) AS w FROM e) GROUP BY event), f AS (SELECT *, s*szz - sz**2 AS det FROM s), r AS (SELECT *, (s*szy - sz*sy) / det AS slope, (szz*sy - sz*szy) / det AS icept FROM f WHERE det > 0) SELECT event, n, round(slope, 5) AS slope, round(icept, 5) AS intercept, round(s / det, 5) AS var_slope, round(szz / det, 5) AS var_intercept, round(syy - slope*szy - icept*sy, 3) AS chi2 FROM r")
def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = moments.line_fit(user_hits(spark, sf_dir), "event", F.col("layer").cast("double"), F.col("strip") / 100.0, 1.0 / (1 + F.col("view")))
    return f.select("event", "n", *[F.round(c, 5).alias(c) for c in ("slope", "intercept", "var_slope", "var_intercept")], F.round("chi2", 3).alias("chi2"))


@query("a14_scattering_energy", f"{E}, m AS (SELECT event, layer, avg(strip) / 100 AS y, count(DISTINCT view) AS views FROM e GROUP BY ALL), t AS (SELECT event, layer, views, atan(lead(y) OVER w - y) - atan(y - lag(y) OVER w) AS theta FROM m WINDOW w AS (PARTITION BY event ORDER BY layer)) SELECT event, count(theta) AS n_angles, round(13.6 / sqrt(sum(CASE WHEN theta IS NULL THEN 0 ELSE views * theta * theta / 0.03 END) / sum(CASE WHEN theta IS NULL THEN 0 ELSE views END)), 4) AS energy FROM t GROUP BY event HAVING sum(CASE WHEN theta IS NULL THEN 0 ELSE views * theta * theta END) > 0")
def scattering_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event").orderBy("layer")
    m = user_hits(spark, sf_dir).groupBy("event", "layer").agg((F.avg("strip") / 100).alias("y"), F.countDistinct("view").alias("views"))
    t = m.withColumn("theta", F.atan(F.lead("y").over(w) - F.col("y")) - F.atan(F.col("y") - F.lag("y").over(w))).filter("theta IS NOT NULL")
    s = t.groupBy("event").agg(F.count("*").alias("n_angles"), F.sum(F.col("views") * F.col("theta") * F.col("theta") / 0.03).alias("q"), F.sum("views").alias("w")).filter("q > 0")
    return s.select("event", "n_angles", F.round(13.6 / F.sqrt(F.col("q") / F.col("w")), 4).alias("energy"))


@query("a15_track_summary", f"{E}, o AS (SELECT *, layer - lag(layer) OVER (PARTITION BY event, view ORDER BY layer, hit) - 1 AS gap FROM e) SELECT event, count(*) FILTER (view = 0) AS n_x, count(*) FILTER (view = 1) AS n_y, coalesce(sum(gap) FILTER (gap > 0 AND view = 0), 0)::BIGINT AS gaps_x, coalesce(sum(gap) FILTER (gap > 0 AND view = 1), 0)::BIGINT AS gaps_y, round(stddev_pop(strip), 4) AS rms FROM o GROUP BY event")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("layer") - F.lag("layer").over(Window.partitionBy("event", "view").orderBy("layer", "hit")) - 1
    o = user_hits(spark, sf_dir).withColumn("gap", gap)
    of = lambda v: F.coalesce(F.sum(F.when((F.col("gap") > 0) & (F.col("view") == v), F.col("gap"))), F.lit(0)).cast("long")
    return o.groupBy("event").agg(F.count(F.when(F.col("view") == 0, 1)).alias("n_x"), F.count(F.when(F.col("view") == 1, 1)).alias("n_y"), of(0).alias("gaps_x"), of(1).alias("gaps_y"), F.round(F.stddev_pop("strip"), 4).alias("rms"))


@query("a16_track_quality", f"{L} SELECT event, round(64.0 * (least(8, count(*) FILTER (view = 0)) + least(8, count(*) FILTER (view = 1))) / least(2 * (max(layer) + 1), 16) - 2 * sqrt(stddev_pop(width)), 5) AS quality FROM l GROUP BY event")
def track_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v: F.least(F.lit(8), F.count(F.when(F.col("view") == v, 1)))
    q = 64.0 * (n(0) + n(1)) / F.least(2 * (F.max("layer") + 1), F.lit(16)) - 2 * F.sqrt(F.stddev_pop("width"))
    return order_hits(spark, sf_dir).groupBy("event").agg(F.round(q, 5).alias("quality"))


@query("a17_segment_chi2", f"{E} SELECT event, round(sum((strip - 768) ** 2 / 100000.0) / greatest(1, count(*) - 4), 3) AS chi2 FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY layer DESC, hit) AS r FROM e) WHERE r <= 6 GROUP BY event")
def segment_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = user_hits(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("event").orderBy(F.desc("layer"), "hit"))).filter("r <= 6")
    return first.groupBy("event").agg(F.round(F.sum((F.col("strip") - 768) ** 2 / 100000.0) / F.greatest(F.lit(1), F.count("*") - 4), 3).alias("chi2"))


@query("a19_running_angles", f"{E}, a AS (SELECT event, hit, layer, atan((strip - 768) / 500.0) AS theta FROM e) SELECT event, hit, count(*) OVER w AS n, round(sqrt(greatest(0.0, avg(theta * theta) OVER w - (avg(theta) OVER w) ** 2)), 5) AS rms, 4 * sqrt(greatest(0.0, avg(theta * theta) OVER w - (avg(theta) OVER w) ** 2)) <= 0.4 AS accepted FROM a WINDOW w AS (PARTITION BY event ORDER BY layer DESC, hit ROWS UNBOUNDED PRECEDING)")
def running_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("event").orderBy(F.desc("layer"), "hit").rowsBetween(Window.unboundedPreceding, 0)
    a = user_hits(spark, sf_dir).withColumn("theta", F.atan((F.col("strip") - 768) / 500.0))
    a = a.select("event", "hit", F.count("*").over(w).alias("n"), F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("theta") * F.col("theta")).over(w) - F.avg("theta").over(w) ** 2)).alias("r"))
    return a.select("event", "hit", "n", F.round("r", 5).alias("rms"), (4 * F.col("r") <= 0.4).alias("accepted"))


@query("a20_path_kink", f"{E}, a AS (SELECT event, layer, layer - lag(layer) OVER w AS step, atan((strip - 768) / 500.0) - lag(atan((strip - 768) / 500.0)) OVER w AS kink FROM e WINDOW w AS (PARTITION BY event ORDER BY layer, hit)) SELECT event, round(sqrt(sum(kink * kink)) / sum(1 + (step > 1)::INT + (step > 2)::INT), 6) AS rms_kink FROM a WHERE kink IS NOT NULL GROUP BY event")
def path_kink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinks along a path; links that skip layers weigh more."""
    w = Window.partitionBy("event").orderBy("layer", "hit")
    theta = F.atan((F.col("strip") - 768) / 500.0)
    a = user_hits(spark, sf_dir).select("event", (F.col("layer") - F.lag("layer").over(w)).alias("step"), (theta - F.lag(theta).over(w)).alias("kink")).filter("kink IS NOT NULL")
    weight = 1 + (F.col("step") > 1).cast("int") + (F.col("step") > 2).cast("int")
    return a.groupBy("event").agg(F.round(F.sqrt(F.sum(F.col("kink") * F.col("kink"))) / F.sum(weight), 6).alias("rms_kink"))


@query("a21_consensus_votes", f"{V}, p AS (SELECT a.grp, a.id, count(*) FILTER (a.id <> b.id AND (a.x*b.x + a.y*b.y + a.z*b.z) > 0.866 * sqrt(a.x**2 + a.y**2 + a.z**2) * sqrt(b.x**2 + b.y**2 + b.z**2)) AS votes, count(*) AS n FROM v a JOIN v b USING (grp) GROUP BY ALL) SELECT grp, id, votes, (1 + votes) * 2 > n AS kept FROM p")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a bin (bounded by the event guards) each direction counts those within 30 degrees of it."""
    v = label_points(spark, sf_dir)
    a = v.select("grp", "id", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = v.select("grp", F.col("id").alias("other"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    near = geo.dot(geo.vec("a"), geo.vec("b")) > 0.866 * geo.length(geo.vec("a")) * geo.length(geo.vec("b"))
    p = a.join(b, "grp").groupBy("grp", "id").agg(F.count(F.when((F.col("id") != F.col("other")) & near, 1)).alias("votes"), F.count("*").alias("n"))
    return p.select("grp", "id", "votes", ((1 + F.col("votes")) * 2 > F.col("n")).alias("kept"))


@query("k2_scalar_filter", f"WITH RECURSIVE {SQL_USERS}, o AS (SELECT event, strip / 100.0 AS m, row_number() OVER (PARTITION BY event ORDER BY layer, hit) AS r FROM e), f AS (SELECT event, r, m::DOUBLE AS x, 4.0::DOUBLE AS p, 0.0::DOUBLE AS chi2 FROM o WHERE r = 1 UNION ALL SELECT o.event, o.r, f.x + (f.p + 0.25) / (f.p + 0.25 + 4.0) * (o.m - f.x), (1 - (f.p + 0.25) / (f.p + 0.25 + 4.0)) * (f.p + 0.25), f.chi2 + (o.m - f.x) * (o.m - f.x) / (f.p + 0.25 + 4.0) FROM f JOIN o ON o.event = f.event AND o.r = f.r + 1) SELECT event, r AS n, round(x, 5) AS x, round(p, 6) AS p, round(chi2, 3) AS chi2 FROM f WHERE r = (SELECT max(r) FROM o WHERE o.event = f.event)")
def scalar_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict and update along the layers (K1, K2, K4): a fold over each event's sorted hits."""
    f = kalman.scalar_filter(user_hits(spark, sf_dir).withColumn("m", F.col("strip") / 100.0), "event", ["layer", "hit"], "m", 0.25, 4.0)
    return f.select("event", F.col("n").cast("long").alias("n"), F.round("x", 5).alias("x"), F.round("p", 6).alias("p"), F.round("chi2", 3).alias("chi2"))


@query("m4_energy_loss", "SELECT o_orderkey AS track, round(greatest(15.0, o_totalprice * exp(-0.03)), 4) AS radiative, round(o_totalprice - 18.3 * 0.03 / (1 - (0.511 / (o_totalprice + 0.511)) ** 2), 4) AS ionising FROM orders WHERE o_totalprice > 1")
def energy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.hits import table

    e = F.col("o_totalprice")
    beta2 = 1 - (0.511 / (e + 0.511)) ** 2
    return table(spark, sf_dir, "orders").filter("o_totalprice > 1").select(F.col("o_orderkey").alias("track"), F.round(F.greatest(F.lit(15.0), e * F.exp(F.lit(-0.03))), 4).alias("radiative"), F.round(e - 18.3 * 0.03 / beta2, 4).alias("ionising"))


@query("m6_ray_approach", f"{V}, r AS (SELECT a.grp, a.id AS first, b.id AS second, b.x - a.x AS wx, b.y - a.y AS wy, b.z - a.z AS wz, a.y*b.z - a.z*b.y AS nx, a.z*b.x - a.x*b.z AS ny, a.x*b.y - a.y*b.x AS nz FROM v a JOIN v b ON a.grp = b.grp AND b.id = a.id + 1) SELECT grp, first, second, round(abs(wx*nx + wy*ny + wz*nz) / sqrt(nx*nx + ny*ny + nz*nz), 5) AS doca FROM r WHERE sqrt(nx*nx + ny*ny + nz*nz) > 1e-9")
def ray_approach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest approach of the rays of neighbouring ids: the point is also the direction."""
    v = label_points(spark, sf_dir)
    a = v.select("grp", F.col("id").alias("first"), (F.col("id") + 1).alias("second"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = v.select("grp", F.col("id").alias("second"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    p, q = geo.vec("a"), geo.vec("b")
    pairs = a.join(b, ["grp", "second"]).filter(geo.length(geo.cross(p, q)) > 1e-9)
    return pairs.select("grp", "first", "second", F.round(geo.ray_distance(p, p, q, q), 5).alias("doca"))


@query("m8_coordinate_to_tower", f"{L} SELECT event, price, floor((strip - 768) / 374.5 + 2)::INT AS tower_x, floor((price % 1500 - 750) / 374.5 + 2)::INT AS tower_y, 2 * layer + view AS plane FROM l")
def coordinate_to_tower(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.floor(c / geo.TOWER_PITCH + 2).cast("int")
    return order_hits(spark, sf_dir).select("event", "price", at(F.col("strip") - 768).alias("tower_x"), at(F.col("price") % 1500 - 750).alias("tower_y"), geo.plane(F.col("layer"), F.col("view")).alias("plane"))


@query("m9_scattering_angle", f"{L} SELECT event, price, round(13.6 * sqrt(0.03 * width) * (1 + 0.038 * ln(0.03 * width)) / (price / 100.0), 6) AS angle FROM l WHERE price > 0")
def scattering_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_hits(spark, sf_dir).filter("price > 0").select("event", "price", F.round(geo.scattering(0.03 * F.col("width"), F.col("price") / 100.0), 6).alias("angle"))


@query("m11_adaptive_cuts", f"{E}, n AS (SELECT event, log10(count(*)) AS g FROM e GROUP BY event) SELECT event, round(g, 6) AS log_n, round(CASE WHEN g < 1.5 THEN 1.0 WHEN g > 3 THEN 0.1 ELSE 1.0 - 0.6 * (g - 1.5) END, 6) AS tolerance FROM n")
def adaptive_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = user_hits(spark, sf_dir).groupBy("event").agg(F.log10(F.count("*")).alias("g"))
    return n.select("event", F.round("g", 6).alias("log_n"), F.round(F.when(F.col("g") < 1.5, 1.0).when(F.col("g") > 3, 0.1).otherwise(1.0 - 0.6 * (F.col("g") - 1.5)), 6).alias("tolerance"))
