"""Queries on trees of links: growth, statistics, leaves and their hits, over links of adjacent layers and those that skip one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import links as lnk
from ..operators import packing, trees
from ..operators.graph import cut_lineage
from .hits import BAND, SQL_EP, SQL_LINKS, user_points
from .register import query

SKIP, LAYERS = 1, 18
CUTS = trees.Cuts()


def sql_growth() -> str:
    """The rules of trees.grow, a layer at a time: the points of a layer are taken in order by folds over lists."""
    cosine = "round((i.sx * o.sx + i.sy * o.sy + 1) / sqrt(i.sx * i.sx + i.sy * i.sy + 1) / sqrt(o.sx * o.sx + o.sy * o.sy + 1), 9)"
    shift = f"{CUTS.offset!r}::DOUBLE / 0.228::DOUBLE"
    parts = [
        SQL_EP
        + SQL_LINKS.format(steps=SKIP + 1, band=BAND)
        + f""",
z AS (SELECT event, log10(count(*)) AS size FROM k GROUP BY event),
zc AS (SELECT event, CASE WHEN size < 2.5 THEN {CUTS.displaced!r}::DOUBLE + 1.69::DOUBLE * (2.5::DOUBLE - size) ** 2 ELSE {CUTS.displaced!r}::DOUBLE END AS displaced,
  CASE WHEN size < 2.5 THEN {CUTS.angle!r}::DOUBLE + {math.pi / 4!r}::DOUBLE - {math.pi!r}::DOUBLE * size / 10 ELSE {CUTS.angle!r}::DOUBLE END AS angle FROM z),
zd AS (SELECT event, round(cos(angle), 9) AS least_cosine, round(displaced + {CUTS.offset!r}::DOUBLE * angle / 0.228::DOUBLE, 9) AS most FROM zc),
ch AS MATERIALIZED (SELECT DISTINCT event, bot_id AS id FROM k WHERE (event, top_id) IN (SELECT (event, bot_id) FROM k)),
s AS MATERIALIZED (SELECT k.event, top_layer, bot_layer, step, top_id, bot_id, (top_x - bot_x) * 0.228::DOUBLE / (step * 32.575::DOUBLE) AS sx, (top_y - bot_y) * 0.228::DOUBLE / (step * 32.575::DOUBLE) AS sy,
  split_part(top_id, ':', 1) AS top_a, split_part(top_id, ':', 2) AS top_b, split_part(bot_id, ':', 1) AS bot_a, split_part(bot_id, ':', 2) AS bot_b, least_cosine, most,
  EXISTS (SELECT 1 FROM ch WHERE ch.event = k.event AND ch.id = k.top_id) AS chained FROM k JOIN zd ON k.event = zd.event)"""
    ]
    node = "event, head, parent_id, top_id, bot_id, top_layer, bot_layer, step, sx, sy, bot_a, bot_b, depth, quad, path, start_layer, chained"
    for layer in range(LAYERS - 1, -1, -1):
        above = range(layer + 1, min(LAYERS, layer + SKIP + 2))
        empty = "SELECT event, top_id AS head, top_id AS parent_id, top_id, bot_id, top_layer, bot_layer, step, sx, sy, bot_a, bot_b, 1 AS depth, 0.0::DOUBLE AS quad, [top_id] AS path, top_layer AS start_layer, chained, 0.0::DOUBLE AS rms, 0 AS layers FROM s WHERE false"
        landed = " UNION ALL ".join(f"SELECT {node}, sqrt(quad) / depth AS rms, start_layer - bot_layer + 1 AS layers FROM n{q} WHERE bot_layer = {layer}" for q in above) or empty
        owners = " UNION ALL ".join(f"SELECT event, bot_a, bot_b, depth, start_layer - bot_layer + 1 AS layers, sqrt(quad) / depth AS rms FROM n{q} WHERE bot_layer < {layer}" for q in above) or "SELECT event, bot_a, bot_b, 1 AS depth, 0 AS layers, 0.0::DOUBLE AS rms FROM s WHERE false"
        parts.append(f"""i{layer} AS MATERIALIZED ({landed}),
w{layer} AS MATERIALIZED ({owners}),
j{layer} AS MATERIALIZED (SELECT *, sqrt(quad + m2) / (depth + 1) AS q FROM (SELECT o.event, o.top_id, o.bot_id, o.step, i.top_id AS parent, i.top_layer AS parent_layer, i.depth, i.quad, dx * dx + dy * dy AS m2, {cosine} AS cosine, o.least_cosine, i.chained, dx, dy, o.most
  FROM s o JOIN i{layer} i ON o.event = i.event AND o.top_id = i.bot_id, LATERAL (SELECT round(abs(i.sx - o.sx) * {shift}, 9) AS dx, round(abs(i.sy - o.sy) * {shift}, 9) AS dy)
  WHERE o.top_layer = {layer} AND NOT (i.layers < 4 AND i.step > 1 AND o.step > 2)) WHERE cosine > least_cosine AND (chained OR cosine >= {round(CUTS.kink, 9)!r}) AND dx < most AND dy < most),
b{layer} AS MATERIALIZED (SELECT event, top_id, list_reduce(list({{'parent': parent, 'n': depth + 1, 'q': q}} ORDER BY step, bot_id, parent_layer DESC, parent), lambda acc, c: CASE WHEN (acc.n <= 2 AND c.n > 3) OR c.q < acc.q THEN c ELSE acc END).parent AS parent FROM j{layer} GROUP BY event, top_id),
d{layer} AS MATERIALIZED (SELECT event, bot_id AS point, list_reduce(list({{'parent': top_id, 'n': depth, 'q': rms}} ORDER BY top_layer DESC, top_id), lambda acc, c: CASE WHEN c.n > acc.n + 2 OR c.q < acc.q THEN c ELSE acc END).parent AS parent
  FROM i{layer} WHERE depth > 1 AND (event, bot_id) NOT IN (SELECT (event, top_id) FROM s WHERE top_layer = {layer}) GROUP BY event, bot_id),
h{layer} AS MATERIALIZED (SELECT s.event, s.top_id, list({{'point': i.bot_id, 'top': i.top_id, 'dead': d.parent IS NOT NULL AND d.parent <> i.top_id, 'best': b.parent IS NOT NULL AND b.parent = i.top_id}}) FILTER (i.event IS NOT NULL) AS rivals
  FROM (SELECT DISTINCT event, top_id, top_a, top_b FROM s WHERE top_layer = {layer} AND NOT chained AND (event, top_id) NOT IN (SELECT (event, top_id) FROM b{layer})) s
  LEFT JOIN i{layer} i ON s.event = i.event AND ((s.top_a = i.bot_a AND i.layers > 2) OR (s.top_b = i.bot_b AND i.depth > 2)) LEFT JOIN d{layer} d ON d.event = i.event AND d.point = i.bot_id LEFT JOIN b{layer} b ON b.event = i.event AND b.top_id = i.bot_id GROUP BY s.event, s.top_id),
cand{layer} AS MATERIALIZED (SELECT s.event, s.top_id, s.bot_id, s.bot_a, s.bot_b, s.step, j.m2, j.parent, i.depth, i.layers, sqrt(i.quad + j.m2) / (i.depth + 1) AS rms, NULL AS rivals FROM j{layer} j JOIN b{layer} b ON j.event = b.event AND j.top_id = b.top_id AND j.parent = b.parent
  JOIN s ON s.event = j.event AND s.top_id = j.top_id AND s.bot_id = j.bot_id JOIN i{layer} i ON i.event = j.event AND i.bot_id = j.top_id AND i.top_id = j.parent
  UNION ALL SELECT s.event, s.top_id, s.bot_id, s.bot_a, s.bot_b, s.step, 0.0, NULL, 0, 0, 0.0, coalesce(rivals, []) FROM h{layer} h JOIN s ON s.event = h.event AND s.top_id = h.top_id),
x{layer} AS MATERIALIZED (SELECT c.* FROM cand{layer} c WHERE NOT EXISTS (SELECT 1 FROM w{layer} w WHERE w.event = c.event AND w.bot_a = c.bot_a AND {refused("w")}) AND NOT EXISTS (SELECT 1 FROM w{layer} w WHERE w.event = c.event AND w.bot_b = c.bot_b AND {refused("w")})),
f{layer} AS (SELECT event, unnest(list_reduce(list({{'point': top_id, 'bot': bot_id, 'a': bot_a, 'b': bot_b, 'depth': depth, 'layers': layers, 'rms': rms, 'step': step, 'rivals': rivals, 'new_layers': greatest(layers, 1) + step}} ORDER BY top_id, step, m2, bot_id),
  lambda acc, c: CASE WHEN len(list_filter(acc, lambda x: (x.a = c.a OR x.b = c.b) AND (x.depth + 1 > c.depth + {CUTS.longer} OR (c.depth <= x.depth + 2 AND x.new_layers >= 3 AND c.layers >= 3 AND c.rms > {CUTS.worse!r} * x.rms)))) > 0
    OR (c.rivals IS NOT NULL AND len(list_filter(c.rivals, lambda r: NOT (r.point < c.point AND (r.dead OR (NOT r.best AND len(list_filter(acc, lambda x: x.point = r.point)) > 0))))) > 0) THEN acc ELSE list_append(acc, c) END,
  []::STRUCT(point VARCHAR, bot VARCHAR, a VARCHAR, b VARCHAR, depth INTEGER, layers INTEGER, rms DOUBLE, step INTEGER, rivals STRUCT(point VARCHAR, top VARCHAR, dead BOOLEAN, best BOOLEAN)[], new_layers INTEGER)[])) AS a FROM x{layer} GROUP BY event),
n{layer} AS MATERIALIZED (SELECT s.event, coalesce(i.head, s.top_id) AS head, c.parent AS parent_id, s.top_id, s.bot_id, s.top_layer, s.bot_layer, s.step, s.sx, s.sy, s.bot_a, s.bot_b, coalesce(i.depth, 0) + 1 AS depth, coalesce(i.quad + c.m2, 0.0) AS quad,
  list_append(coalesce(i.path, [s.top_id]), s.bot_id) AS path, coalesce(i.start_layer, s.top_layer) AS start_layer, s.chained FROM f{layer} f JOIN cand{layer} c ON c.event = f.event AND c.top_id = f.a.point AND c.bot_id = f.a.bot
  JOIN s ON s.event = c.event AND s.top_id = c.top_id AND s.bot_id = c.bot_id LEFT JOIN i{layer} i ON i.event = c.event AND i.bot_id = c.top_id AND i.top_id = c.parent),
e{layer} AS MATERIALIZED (SELECT i.* FROM i{layer} i LEFT JOIN d{layer} d ON d.event = i.event AND d.point = i.bot_id LEFT JOIN b{layer} b ON b.event = i.event AND b.top_id = i.bot_id
  LEFT JOIN (SELECT DISTINCT event, top_id FROM n{layer}) g ON g.event = i.event AND g.top_id = i.bot_id WHERE coalesce(d.parent = i.top_id, true) AND (g.event IS NULL OR coalesce(b.parent = i.top_id, false)))""")
    parts.append("n AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT event, head, parent_id, top_id, bot_id, bot_layer, step, sx, sy, depth, depth - 1 AS n_angles, quad, path, start_layer - bot_layer + 1 AS layers FROM e{q}" for q in range(LAYERS)) + ")")
    return ",\n".join(parts)


def refused(owner: str) -> str:
    """Whether an owner of a cluster keeps candidate c out."""
    return f"({owner}.depth > c.depth + {CUTS.longer} OR (c.depth <= {owner}.depth + 1 AND {owner}.layers >= 3 AND c.layers >= 3 AND c.rms > {CUTS.worse!r} * {owner}.rms))"


def sql_statistics() -> str:
    """The steps of trees.statistics."""
    own = "CASE WHEN n_angles > 0 THEN sqrt(quad) / n_angles ELSE 0.0::DOUBLE END"
    parts = []
    for layer in range(LAYERS - 1):
        lower = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(max(0, layer - SKIP - 1), layer))
        if lower:
            parts.append(f"""c{layer} AS (SELECT event, parent_id AS p, top_id AS t, sum(n_leaves)::BIGINT AS c_leaves, sum(CASE WHEN below > 2 THEN greatest(n_branches, 1) ELSE 0 END)::BIGINT AS c_branches,
  max(below) AS c_below, arg_min(most_points, (-below, round(best_rms, 9), bot_id)) AS c_points, arg_min(best_rms, (-below, round(best_rms, 9), bot_id)) AS c_rms, arg_min(best_path, (-below, round(best_rms, 9), bot_id)) AS c_path FROM ({lower}) WHERE parent_id IS NOT NULL GROUP BY ALL)""")
            join = f"LEFT JOIN c{layer} c ON n.event = c.event AND n.top_id = c.p AND n.bot_id = c.t"
            values = f"coalesce(c_leaves, 1) AS n_leaves, coalesce(c_branches, 0) AS n_branches, coalesce(c_below + 1, 1) AS below, coalesce(c_points, len(path)) AS most_points, coalesce(c_rms, {own}) AS best_rms, coalesce(c_path, path) AS best_path"
        else:
            join, values = "", f"1::BIGINT AS n_leaves, 0::BIGINT AS n_branches, 1 AS below, len(path) AS most_points, {own} AS best_rms, path AS best_path"
        parts.append(f"s{layer} AS MATERIALIZED (SELECT n.*, {values} FROM n {join} WHERE n.bot_layer = {layer})")
    parts.append("t AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(LAYERS - 1)) + ")")
    return ",\n".join(parts)


GROWTH = sql_growth()
STATISTICS = f"{GROWTH},\n{sql_statistics()}"
LEAVES = f"""{STATISTICS},
l1 AS (SELECT event, head, bot_id AS leaf, path, len(path) AS n_points, best_rms AS rms FROM t WHERE below = 1),
l2 AS (SELECT *, row_number() OVER w AS rank, first_value(path) OVER w AS best FROM l1 WINDOW w AS (PARTITION BY event, head ORDER BY n_points DESC, round(rms, 9), leaf, path)),
l3 AS (SELECT *, len(list_intersect(path, best)) AS n_shared FROM l2),
lv AS MATERIALIZED (SELECT *, rank = 1 OR n_points - n_shared > 2 AS accepted FROM l3)"""


def with_clusters(links: DataFrame) -> DataFrame:
    """Links of points with x_hit and y_hit: slopes, and the clusters of both points."""
    clusters = {f"{end}_{k}": F.col(f"{end}_{view}_hit").cast("string") for end in ("top", "bot") for k, view in (("a", "x"), ("b", "y"))}
    return trees.with_slopes(links).withColumns(clusters)


def cluster_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of user_links with their slopes and the clusters of their points."""
    dx, dy = F.col("top_x") - F.col("bot_x"), F.col("top_y") - F.col("bot_y")
    return with_clusters(lnk.links(user_points(spark, sf_dir), SKIP, dx * dx + dy * dy <= 250000, ("x_hit", "y_hit")))


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.grow(cluster_links(spark, sf_dir), CUTS)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all nodes; the trees are grown once and written, as several branches of the plan read them."""
    return trees.statistics(cut_lineage(grown(spark, sf_dir)))


@query("t1_growth", f"{GROWTH} SELECT event, head, parent_id, top_id, bot_id, depth, n_angles, round(quad, 6) AS quad FROM n")
def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the greedy growth (T1) with the choice of the best node and the vetoes."""
    return grown(spark, sf_dir).select("event", "head", "parent_id", "top_id", "bot_id", "depth", "n_angles", F.round("quad", 6).alias("quad"))


@query("t5_node_statistics", f"{STATISTICS} SELECT event, head, top_id, bot_id, n_leaves, n_branches, below, most_points, round(best_rms, 6) AS best_rms FROM t")
def node_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics(spark, sf_dir)
    return found.select("event", "head", "top_id", "bot_id", "n_leaves", F.col("n_branches").cast("long").alias("n_branches"), "below", "most_points", F.round("best_rms", 6).alias("best_rms"))


@query("t8_siblings", f"{GROWTH} SELECT event, head, bot_layer AS layer, count(*) AS n_siblings, min(bot_id) AS first_point, count(DISTINCT bot_id) AS n_points FROM n GROUP BY event, head, bot_layer")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each tree by layer."""
    n = grown(spark, sf_dir).groupBy("event", "head", F.col("bot_layer").alias("layer"))
    return n.agg(F.count("*").alias("n_siblings"), F.min("bot_id").alias("first_point"), F.countDistinct("bot_id").alias("n_points"))


@query("t10_ranked_leaves", f"{LEAVES} SELECT event, head, leaf, rank, n_points, n_shared, accepted FROM lv")
def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.ranked_leaves(statistics(spark, sf_dir))
    return found.select("event", "head", "leaf", "rank", "n_points", "n_shared", "accepted")


SQL_HITS = f"""{LEAVES},
a AS (SELECT event, head, leaf, unnest(path) AS point_id FROM lv WHERE rank = 1),
r AS (SELECT a.event, a.head, a.leaf, p.layer, a.point_id, p.x::DOUBLE AS x, p.y::DOUBLE AS y FROM a JOIN p ON a.event = p.event AND a.point_id = p.id),
d AS (SELECT *, lead(layer) OVER w AS nl, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM r WINDOW w AS (PARTITION BY event, head, leaf ORDER BY layer DESC)),
g AS (SELECT *, unnest(generate_series(1, layer - nl - 1)) AS q FROM d WHERE layer - nl > 1)
SELECT event, head, layer, point_id, round(x, 6) AS x, round(y, 6) AS y, false AS gap FROM r
UNION ALL SELECT event, head, (layer - q)::INT, NULL, round(x + (nx - x) * (q / (layer - nl)), 6), round(y + (ny - y) * (q / (layer - nl)), 6), true FROM g"""


@query("t12_leaf_hits", SQL_HITS)
def best_leaf_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each tree's best leaf, with gap hits for skipped layers."""
    best = trees.ranked_leaves(statistics(spark, sf_dir)).filter("rank = 1")
    found = trees.leaf_hits(best, user_points(spark, sf_dir))
    return found.select("event", "head", "layer", "point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "gap")


PACKING = packing.Packing()
MARKS = "(list_has_any(acc.{0}_a, [h.a for h in p.hits]) OR list_has_any(acc.{0}_b, [h.b for h in p.hits]))"
LINKS_OF = "(len(p.hits) - 1)"


def sql_added(name: str, view: str) -> str:
    """The clusters that a taken path adds to a list; no cluster here is wide."""
    place = f"k - 1 > CASE WHEN {LINKS_OF} < 4 THEN 0 ELSE {PACKING.shared} END" if name == "outs" else f"k - 1 = {name[4:]} AND k - 1 <= CASE WHEN {LINKS_OF} < 4 THEN 0 ELSE {PACKING.shared} END"
    return f"'{name}_{view}': list_concat(acc.{name}_{view}, list_transform(list_filter(range(1, len(p.hits) + 1), lambda k: {place}), lambda k: p.hits[k].{view}))"


LISTS = [f"{name}_{view}" for name in ("outs", "mark0", "mark1", "mark2") for view in "ab"]
SQL_PACKED = f"""{LEAVES},
pp AS (SELECT event, head || '>' || leaf AS path_id, row_number() OVER (PARTITION BY event ORDER BY n_points DESC, round(rms, 9), head, leaf, path)::INT AS rank, path FROM lv),
ph AS (SELECT pp.*, p.layer AS start_layer, [{{'a': split_part(x, ':', 1), 'b': split_part(x, ':', 2)}} for x in path] AS hits FROM pp JOIN p ON pp.event = p.event AND pp.path[1] = p.id),
pg AS (SELECT event, list_reduce(list({{'rank': rank, 'path_id': path_id, 'start_layer': start_layer, 'hits': hits}} ORDER BY rank), lambda acc, p:
  CASE WHEN len(acc.taken) < {PACKING.most} AND {LINKS_OF} >= 1 AND NOT {MARKS.format("outs")} AND NOT (NOT {MARKS.format("mark0")} AND ({MARKS.format("mark1")} OR {MARKS.format("mark2")}))
    AND NOT ({LINKS_OF} < acc.least AND p.start_layer < coalesce(acc.top, p.start_layer) - 2)
  THEN {{'taken': list_append(acc.taken, p.path_id), 'least': greatest(acc.least, {LINKS_OF} - 4), 'top': coalesce(acc.top, p.start_layer), {", ".join(sql_added(*x.split("_")) for x in LISTS)}}}
  ELSE {{'taken': acc.taken, 'least': acc.least, 'top': coalesce(acc.top, p.start_layer), {", ".join(f"'{x}': acc.{x}" for x in LISTS)}}} END,
  {{'taken': []::VARCHAR[], 'least': {PACKING.least_links}::BIGINT, 'top': NULL::INT, {", ".join(f"'{x}': []::VARCHAR[]" for x in LISTS)}}}).taken AS taken FROM ph GROUP BY event)
SELECT event, (k - 1)::INT AS track, taken[k] AS path_id FROM (SELECT event, taken, unnest(range(1, len(taken) + 1)) AS k FROM pg)"""


def leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of all leaves as packing.pack takes them: longest first, then straightest, ties by head, leaf and path; the clusters of a point are its hits."""
    leaves_ = trees.ranked_leaves(statistics(spark, sf_dir))
    order = Window.partitionBy("event").orderBy(F.desc("n_points"), F.round("rms", 9), "head", "leaf", "path")
    hit = lambda x: F.struct(F.split(x, ":")[0].alias("a"), F.split(x, ":")[1].alias("b"), F.lit(False).alias("wide"))
    tops = user_points(spark, sf_dir).select("event", F.col("id").alias("head"), F.col("layer").alias("start_layer"))
    return leaves_.join(tops, ["event", "head"]).select("event", F.concat_ws(">", "head", "leaf").alias("path_id"), F.row_number().over(order).alias("rank"), "start_layer", F.transform("path", hit).alias("hits"))


@query("o6_packed_tracks", SQL_PACKED)
def packed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all trees that become tracks when the best is taken first and its hits are shared by the rules alone."""
    return packing.pack(leaf_paths(spark, sf_dir), PACKING)


KEPT = f"""{STATISTICS},
q1 AS (SELECT event, head, arg_min({{'bot_id': bot_id, 'sx': sx, 'sy': sy, 'below': below, 'top_layer': bot_layer + step, 'path': best_path}}, (-below, round(best_rms, 9), bot_id)) AS best FROM t WHERE parent_id IS NULL GROUP BY event, head),
q2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY event ORDER BY best.top_layer DESC, head) AS place FROM q1),
q3 AS MATERIALIZED (SELECT t.*, q2.best.path AS main, place, parent_id IS NULL AND below = 1 AND bot_id <> best.bot_id AND
  round((sx * best.sx + sy * best.sy + 1) / sqrt(sx * sx + sy * sy + 1) / sqrt(best.sx * best.sx + best.sy * best.sy + 1), 9) < 0.975 AS stub FROM t JOIN q2 ON t.event = q2.event AND t.head = q2.head),
q4 AS (SELECT h.event, h.place, h.best.below > 1 AS deep, list({{'place': r.place, 'stub': r.stub}}) FILTER (r.event IS NOT NULL) AS rivals FROM q2 h LEFT JOIN q3 r ON h.event = r.event AND ((split_part(h.head, ':', 1) = split_part(r.bot_id, ':', 1) AND r.layers > 2) OR (split_part(h.head, ':', 2) = split_part(r.bot_id, ':', 2) AND r.depth > 2)) GROUP BY ALL),
q5 AS (SELECT event, list_reduce(list({{'place': place, 'deep': deep, 'rivals': coalesce(rivals, [])}} ORDER BY place), lambda acc, h: CASE WHEN h.deep AND len(list_filter(h.rivals, lambda r: r.place >= h.place OR (NOT r.stub AND list_contains(acc, r.place)))) = 0 THEN list_append(acc, h.place) ELSE acc END, []::BIGINT[]) AS stay FROM q4 GROUP BY event),
kp AS MATERIALIZED (SELECT q3.*, len(path) - len(list_filter(range(1, len(path) + 1), lambda k: path[1:k] = main[1:k])) AS distance FROM q3 JOIN q5 ON q3.event = q5.event WHERE list_contains(stay, place) AND NOT stub)"""


def kept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.kept(cut_lineage(statistics(spark, sf_dir)))


@query("t7_kept_trees", f"{KEPT} SELECT event, head, count(*) AS n_nodes, max(depth) AS most_links, sum((below = 1)::INT)::BIGINT AS n_leaves FROM kp GROUP BY event, head")
def kept_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees that stay once stubs at their heads are gone (T6) and heads are short or on clusters of other trees."""
    return kept_nodes(spark, sf_dir).groupBy("event", "head").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("most_links"), F.count(F.when(F.col("below") == 1, 1)).alias("n_leaves"))


@query("t8_main_distance", f"{KEPT} SELECT event, head, bot_layer AS layer, count(*) AS n_siblings, max(distance)::INT AS furthest, sum((distance = 0)::INT)::BIGINT AS n_main FROM kp GROUP BY ALL")
def main_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each kept tree by layer, with their distance to the main branch."""
    rows = kept_nodes(spark, sf_dir).withColumn("distance", trees.main_distance()).groupBy("event", "head", F.col("bot_layer").alias("layer"))
    return rows.agg(F.count("*").alias("n_siblings"), F.max("distance").alias("furthest"), F.count(F.when(F.col("distance") == 0, 1)).alias("n_main"))


@query("t10_leaf_order", f"{KEPT} SELECT event, head, bot_id AS leaf, distance::INT AS distance, row_number() OVER (PARTITION BY event, head ORDER BY CASE WHEN distance = 0 THEN 100000 ELSE distance END DESC, round(best_rms * layers, 9), bot_id, path) AS rank FROM kp WHERE below = 1")
def leaf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of kept trees in the order in which tracks are sought."""
    return trees.ordered_leaves(kept_nodes(spark, sf_dir)).select("event", "head", "leaf", "distance", "rank")
