"""Queries on tracks followed from the links of packed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import LAYER_PITCH, STRIP_PITCH, TRAY_WIDTH
from ..operators import following, packing, vertices
from ..operators.graph import cut_lineage
from ..sources.hits import user_hits
from .hits import user_points
from .register import query
from .trees import PACKING, SQL_PACKED, leaf_paths

RULES = following.Following()
STATE = ("ap", "as_", "app", "aps", "ass", "bp", "bs", "bpp", "bps", "bss")
COUNTS = ("on_", "gaps", "row_", "n_a", "n_b", "last_")


def sql_nearest(plane: str, position: str, slope: str, variance: str) -> str:
    far = f"least({RULES.sigmas!r}::DOUBLE * sqrt({variance} + ({RULES.thickness!r}::DOUBLE * {slope}) * ({RULES.thickness!r}::DOUBLE * {slope})), {TRAY_WIDTH / 4!r}::DOUBLE)"
    width = f"floor(greatest({RULES.thickness!r}::DOUBLE * abs({slope}) / {STRIP_PITCH!r}::DOUBLE - 1, 1.0::DOUBLE))"
    edge = f"(c.first_strip % {RULES.ladder} = 0 OR (c.first_strip + 1) % {RULES.ladder} = 0)"
    return f"list_sort(list_transform(list_filter(d.found, lambda c: c.plane = {plane} AND abs(c.position - {position}) < {far} AND (1 >= {width} OR {edge})), lambda c: {{'distance': abs(c.position - {position}), 'cluster': c.cluster, 'position': c.position}}))[1]"


def sql_follow() -> str:
    """The steps of following.follow as folds over lists; tracks are the packed paths."""
    measured, free, pitch = f"{RULES.resolution * RULES.resolution!r}::DOUBLE", f"{RULES.unmeasured!r}::DOUBLE", f"{LAYER_PITCH!r}::DOUBLE"
    slope_error = f"{RULES.slope_error**2!r}::DOUBLE"
    dz = f"((acc.last_ // 2 - k // 2) * {pitch})"
    noise = f"CASE WHEN {dz} > 0 THEN {RULES.noise!r}::DOUBLE ELSE 0.0::DOUBLE END"
    predicted = []
    for v, s in (("a", "as_"), ("b", "bs")):
        predicted += [f"'{v}p': acc.{v}p - acc.{s} * {dz}", f"'{s}': acc.{s}", f"'{v}pp': acc.{v}pp - 2 * {dz} * acc.{v}ps + {dz} * {dz} * acc.{v}ss", f"'{v}ps': acc.{v}ps - {dz} * acc.{v}ss", f"'{v}ss': acc.{v}ss + {noise}"]
    of = lambda a, b: f"(CASE WHEN k % 2 = 0 THEN q.{a} ELSE q.{b} END)"
    new = {}
    for v, s, view in (("a", "as_", 0), ("b", "bs", 1)):
        whole, off, takes = f"(q.{v}pp + {measured})", f"(c.position - q.{v}p)", f"k % 2 = {view} AND c IS NOT NULL"
        values = {f"{v}p": f"q.{v}p + q.{v}pp / {whole} * {off}", s: f"q.{s} + q.{v}ps / {whole} * {off}", f"{v}pp": f"q.{v}pp - q.{v}pp * q.{v}pp / {whole}", f"{v}ps": f"q.{v}ps - q.{v}pp * q.{v}ps / {whole}", f"{v}ss": f"q.{v}ss - q.{v}ps * q.{v}ps / {whole}"}
        new |= {c: f"(CASE WHEN {takes} THEN {x} ELSE q.{c} END)" for c, x in values.items()}
        new[f"n_{v}"] = f"acc.n_{v} + ({takes})::INT"
    gaps, row = "acc.gaps + (c IS NULL)::INT", "CASE WHEN c IS NULL THEN acc.row_ + 1 ELSE 0 END"
    inside = f"q.ap >= 0 AND q.ap <= {RULES.extent!r}::DOUBLE AND q.bp >= 0 AND q.bp <= {RULES.extent!r}::DOUBLE"
    steep = f"c IS NOT NULL AND (abs({new['as_']}) > {RULES.steepest!r}::DOUBLE OR abs({new['bs']}) > {RULES.steepest!r}::DOUBLE)"
    told = {**new, "on_": f"NOT ({steep})", "gaps": gaps, "row_": row, "last_": "k"}
    grown = ", ".join(f"'{c}': {told[c]}" for c in (*STATE, *COUNTS)) + ", 'hits': list_append(acc.hits, {'plane': k, 'cluster': c.cluster})"
    ended = ", ".join(f"'{c}': false" if c == "on_" else f"'{c}': acc.{c}" for c in (*STATE, *COUNTS)) + ", 'hits': acc.hits"
    step = f"""CASE WHEN NOT acc.on_ THEN acc ELSE list_transform([{{{", ".join(predicted)}}}], lambda q: list_transform([{sql_nearest("k", of("ap", "bp"), of("as_", "bs"), of("app", "bpp"))}], lambda c:
  CASE WHEN {inside} AND {gaps} <= {RULES.gaps} AND {row} <= {RULES.gaps_in_a_row} THEN {{{grown}}} ELSE {{{ended}}} END)[1])[1] END"""
    start = f"""{{'ap': x, 'as_': sx, 'app': {free}, 'aps': 0.0::DOUBLE, 'ass': {slope_error}, 'bp': y, 'bs': sy, 'bpp': {measured}, 'bps': 0.0::DOUBLE, 'bss': {slope_error},
  'on_': true, 'gaps': 0, 'row_': 0, 'n_a': 0, 'n_b': 1, 'last_': plane, 'hits': [{{'plane': plane, 'cluster': first.cluster}}]}}"""
    packed = SQL_PACKED[: SQL_PACKED.rindex("SELECT event, (k - 1)::INT AS track")]
    tracks = SQL_PACKED[SQL_PACKED.rindex("SELECT event, (k - 1)::INT AS track") :]
    return f"""{packed},
ta AS ({tracks}),
tb AS (SELECT ta.event, ta.track, pp.path[1] AS top, pp.path[2] AS bot FROM ta JOIN pp ON ta.event = pp.event AND ta.path_id = pp.path_id),
se AS (SELECT tb.event, tb.track, 2 * t.layer + 1 AS plane, t.x * {STRIP_PITCH!r}::DOUBLE AS x, t.y * {STRIP_PITCH!r}::DOUBLE AS y, (t.x - b.x) * {STRIP_PITCH!r}::DOUBLE / ((t.layer - b.layer) * {pitch}) AS sx, (t.y - b.y) * {STRIP_PITCH!r}::DOUBLE / ((t.layer - b.layer) * {pitch}) AS sy
  FROM tb JOIN p t ON tb.event = t.event AND tb.top = t.id JOIN p b ON tb.event = b.event AND tb.bot = b.id),
cl AS (SELECT event, list({{'cluster': hit, 'plane': 2 * layer + view, 'position': strip * {STRIP_PITCH!r}::DOUBLE, 'first_strip': strip}}) AS found FROM e GROUP BY event),
fi AS (SELECT d.*, {sql_nearest("plane", "y", "sy", f"{RULES.first_variance!r}::DOUBLE")} AS first FROM (SELECT se.*, cl.found FROM se JOIN cl ON se.event = cl.event) d),
en AS (SELECT event, track, list_reduce(range(plane - 1, -1, -1)::INT[], lambda acc, k: {step}, {start}) AS z FROM fi d WHERE first IS NOT NULL),
hs AS (SELECT event, track, z.n_a + z.n_b >= {RULES.least_hits} AND least(z.n_a, z.n_b) >= {RULES.least_of_view} AS found, z.hits AS hits, list_max(list_transform(range(1, len(z.hits) + 1), lambda i: CASE WHEN z.hits[i].cluster IS NOT NULL THEN i END)) AS n FROM en)
SELECT event, track, found, i::INT - 1 AS place, hits[i].plane AS plane, hits[i].cluster AS cluster FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM hs)"""


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that start at the heads of packed paths, along their first links."""
    paths = cut_lineage(leaf_paths(spark, sf_dir))
    tracks = packing.pack(paths, PACKING).join(paths.select("event", "path_id", "hits"), ["event", "path_id"])
    name = lambda k: F.concat_ws(":", F.col("hits")[k]["a"], F.col("hits")[k]["b"])
    ends = tracks.select("event", "track", name(0).alias("top_id"), name(1).alias("bot_id"))
    p = user_points(spark, sf_dir)
    for end in ("top", "bot"):
        ends = ends.join(p.select("event", *[F.col(c).alias(f"{end}_{c}") for c in ("id", "layer", "x", "y")]), ["event", f"{end}_id"])
    rise = (F.col("top_layer") - F.col("bot_layer")) * LAYER_PITCH
    slopes = {f"s{a}": (F.col(f"top_{a}") - F.col(f"bot_{a}")) * STRIP_PITCH / rise for a in "xy"}
    seeds = ends.withColumns(slopes).select("event", "track", (2 * F.col("top_layer") + 1).alias("plane"), *[(F.col(f"top_{a}") * STRIP_PITCH).alias(a) for a in "xy"], "sx", "sy")
    return following.follow(seeds, plane_clusters(spark, sf_dir), RULES)


@query("h1_followed_hits", sql_follow())
def followed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits and gaps of followed tracks (H1, H5)."""
    found = followed(spark, sf_dir).select("event", "track", "found", F.posexplode("hits").alias("place", "hit"))
    return found.select("event", "track", "found", "place", "hit.plane", "hit.cluster")


@query("x1_greedy_vertices")
def greedy_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of an event's followed tracks, the best partner first (X1). Their lines and covariances are fitted to their hits; a
    track's energy is half that of the one before, 30 MeV at least. The given strips are random, so approaches and qualities are
    gated widely here; the defaults are the fixed values."""
    found = cut_lineage(followed(spark, sf_dir).filter("found").select("event", "track", F.explode("hits").alias("hit")).select("event", "track", "hit.*").filter("cluster IS NOT NULL"))
    at = plane_clusters(spark, sf_dir).select("event", "cluster", "position")
    hits = found.join(at, ["event", "cluster"]).withColumns({"view": F.col("plane") % 2, "z": F.floor(F.col("plane") / 2) * LAYER_PITCH})
    first = found.groupBy("event", "track").agg(F.max(F.struct("plane", "cluster")).alias("first"))
    energy = F.greatest(F.lit(30.0), 1000.0 / F.expr("shiftleft(1, track)"))
    more = first.select("event", "track", F.floor(F.col("first.plane") / 2).cast("int").alias("layer"), F.col("first.cluster").cast("string").alias("cluster"), F.lit(1).alias("width"), energy.alias("energy"))
    tracks = cut_lineage(vertices.line_states(hits).join(more, ["event", "track"]))
    out = vertices.vertices(tracks, vertices.Vertexing(most_doca=50.0, least_quality=-1e6))
    return out.select("event", "first", "second", F.round("quality", 3).alias("quality"), F.round("doca", 4).alias("doca"), F.round("z", 4).alias("z"), "status")


def plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as clusters of one strip in their planes."""
    e = user_hits(spark, sf_dir)
    return e.select("event", F.col("hit").alias("cluster"), (2 * F.col("layer") + F.col("view")).alias("plane"), (F.col("strip") * STRIP_PITCH).alias("position"), F.lit(1).alias("width"), F.col("strip").alias("first_strip"))
