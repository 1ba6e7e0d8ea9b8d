"""Trees of links: growth with competition for clusters, statistics, choice of leaves, hits of a leaf.

A node is a link that was attached: it stands on its bottom point and hangs on the node that ends at its top point. Growth
depends on the order in which an event's points are taken, so it is a fold over the event's links: one grouping by event (no
exchange where the links lie together by event), no rounds; the guards of the first pass bound an event. All else is grouping and joining by event.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import LAYER_PITCH, STRIP_PITCH


@dataclass(frozen=True)
class Cuts:
    """Kink at a tree's first links, angle between links, displacement in strips, the offset at which it is taken
    (mm); a newcomer to a cluster is refused beside a node of `longer` more angles, or `worse` times straighter, unless the
    cluster is wider than `wide`."""

    kink: float = math.cos(math.pi / 8)
    angle: float = math.pi / 4
    displaced: float = 1.25
    offset: float = 0.6
    longer: int = 2
    worse: float = 100.0
    wide: int = 4

    @property
    def most(self) -> float:
        return self.displaced + self.offset * self.angle / STRIP_PITCH

    def of_event(self, n_links: int, energy: float | None = None) -> Cuts:
        """Wider cuts for events of few links, which are probably of low energy."""
        size = math.log10(n_links) if n_links else 0.0
        wider = self
        if size < 2.5:
            wider = replace(self, displaced=self.displaced + 1.69 * (2.5 - size) ** 2, angle=self.angle + math.pi / 4 - math.pi * size / 10)
        if size < 3.0 and energy is not None and energy < 400.0:
            wider = replace(wider, kink=math.cos(max(2.0, (4.0 - energy / 100.0) / 2) * math.pi / 8))
        return wider


def with_slopes(links: DataFrame) -> DataFrame:
    """links of operators.links with sx, sy: slopes in both views, from strips and layers."""
    rise = F.col("step") * LAYER_PITCH
    return links.withColumns({f"s{a}": (F.col(f"top_{a}") - F.col(f"bot_{a}")) * STRIP_PITCH / rise for a in "xy"})


class Link(NamedTuple):
    """A row of links() with slopes; a and b: the clusters of its points in the two views."""

    event: int
    top_layer: int
    top_id: str
    step: int
    bot_id: str
    bot_layer: int
    sx: float
    sy: float
    top_a: str
    top_b: str
    bot_a: str
    bot_b: str
    wide_a: int
    wide_b: int
    gap: bool


@dataclass(eq=False)
class Node:
    """An attached link: the layer at which its tree starts, links from the head, summed squared displacements."""

    link: Link
    parent: Node | None
    start: int
    depth: int
    quad: float
    path: list[str]
    alive: bool = True

    @property
    def layers(self) -> int:
        return self.start - self.link.bot_layer + 1

    @property
    def rms(self) -> float:
        return math.sqrt(self.quad) / self.depth


def displacement(upper: Link, lower: Link, straight: bool, cuts: Cuts) -> float | None:
    """The squared displacement in strips of two links beside the point they share; None if they bend or miss too much."""
    cosine = (upper.sx * lower.sx + upper.sy * lower.sy + 1) / math.sqrt(upper.sx * upper.sx + upper.sy * upper.sy + 1) / math.sqrt(lower.sx * lower.sx + lower.sy * lower.sy + 1)
    cosine = round(cosine, 9)
    if cosine <= round(math.cos(cuts.angle), 9) or (straight and cosine < round(cuts.kink, 9)):
        return None
    dx, dy = (round(abs(p - q) * cuts.offset / STRIP_PITCH, 9) for p, q in ((upper.sx, lower.sx), (upper.sy, lower.sy)))
    dx, dy = dx / max(1, upper.wide_a), dy / max(1, upper.wide_b)
    most = round(cuts.most, 9)
    return dx * dx + dy * dy if dx < most and dy < most else None


@dataclass
class Growth:
    """The trees of one event while its points are taken: nodes by the point and by the clusters on which they end."""

    cuts: Cuts
    chained: set[str]
    at: dict[str, list[Node]] = field(default_factory=lambda: defaultdict(list))
    on: dict[tuple[str, str], list[Node]] = field(default_factory=lambda: defaultdict(list))

    def take(self, point: str, links: list[Link]) -> None:
        """Attaches the links that start at a point to the best node that ends there, or starts a tree; losers go."""
        ends = self.at[point]
        if not links:
            self.arbitrate(ends)
            return
        best, fits = self.best(ends, links)
        if best is None and not self.starts(point, links[0]):
            return
        grown: list[Node] = []
        for square, link in fits if best else [(0.0, x) for x in links]:
            if best is None and (link.step > 4 or (link.step > 2 and (not link.gap or (grown and grown[0].link.step == 1)))):
                continue
            if not self.refused(best, link, square):
                path = [*(best.path if best else [link.top_id]), link.bot_id]
                node = Node(link, best, best.start if best else link.top_layer, best.depth + 1 if best else 1, best.quad + square if best else 0.0, path)
                grown.append(node)
                self.at[link.bot_id].append(node)
                for cluster in (("a", link.bot_a), ("b", link.bot_b)):
                    self.on[cluster].append(node)
        if grown:
            self.drop(x for x in ends if x is not best)

    def best(self, ends: list[Node], links: list[Link]) -> tuple[Node | None, list[tuple[float, Link]]]:
        """The node that the links suit best, and its links, those without skipped layers first, then the straightest."""
        best, least, most = None, 1000.0, 0
        fits: dict[int, list[tuple[float, Link]]] = defaultdict(list)
        for link in links:
            for node in ends:
                if node.layers < 4 and node.link.step > 1 and link.step > 2:
                    continue
                square = displacement(node.link, link, node.link.top_id not in self.chained, self.cuts)
                if square is None:
                    continue
                fits[id(node)].append((square, link))
                n = node.depth + 1
                rms = math.sqrt(node.quad + square) / n
                if (most <= 2 and n > 3) or rms < least:
                    best, least, most = node, rms, n
        return best, sorted(fits[id(best)], key=lambda x: (x[1].step, x[0], x[1].bot_id)) if best else []

    def refused(self, node: Node | None, link: Link, square: float) -> bool:
        """Whether a cluster of the link's lower point belongs to a node that keeps newcomers out."""
        depth, layers = (node.depth, node.layers) if node else (0, 0)
        rms = math.sqrt(node.quad + square) / (depth + 1) if node else 0.0
        for cluster, wide in ((("a", link.bot_a), link.wide_a), (("b", link.bot_b), link.wide_b)):
            for other in self.on.get(cluster, ()):
                if other.depth > depth + self.cuts.longer:
                    return True
                alike = depth <= other.depth + 1 and min(other.layers, layers) >= 3 and wide <= self.cuts.wide
                if alike and rms > self.cuts.worse * other.rms:
                    return True
        return False

    def starts(self, point: str, link: Link) -> bool:
        """Whether a tree may start: the point is no second one of a chain, and no longer tree ends on its clusters."""
        own_a, own_b = self.on.get(("a", link.top_a), ()), self.on.get(("b", link.top_b), ())
        return point not in self.chained and all(x.layers <= 2 for x in own_a) and all(x.depth <= 2 for x in own_b)

    def arbitrate(self, ends: list[Node]) -> None:
        """Of the nodes at a dead end the longer or straighter one stays, if any has two links."""
        best, least, most = None, 2 * math.pi, -1
        for node in ends:
            if node.depth > 1 and (node.depth > most + 2 or node.rms < least):
                best, least, most = node, node.rms, node.depth
        if best:
            self.drop(x for x in ends if x is not best)

    def drop(self, losers: Iterable[Node]) -> None:
        for node in list(losers):
            node.alive = False
            self.at[node.link.bot_id].remove(node)
            for cluster in (("a", node.link.bot_a), ("b", node.link.bot_b)):
                self.on[cluster].remove(node)


def grow_event(links: list[Link], cuts: Cuts) -> Iterator[Node]:
    """links: those of one event by falling layer, then by point, steps and lower point, which is the order of all choices."""
    below: dict[str, list[Link]] = defaultdict(list)
    layer_of: dict[str, int] = {}
    for link in links:
        below[link.top_id].append(link)
        layer_of[link.top_id], layer_of[link.bot_id] = link.top_layer, link.bot_layer
    ends = {link.bot_id for link in links}
    growth = Growth(cuts.of_event(len(links)), {link.bot_id for link in links if link.top_id in ends})
    for point in sorted(layer_of, key=lambda p: (-layer_of[p], p)):
        growth.take(point, below.get(point, []))
    for point in layer_of:
        yield from growth.at[point]


NODE = ("event", "head", "parent_id", "top_id", "bot_id", "bot_layer", "step", "sx", "sy", "depth", "n_angles", "quad", "path", "layers", "top_a", "top_b", "bot_a", "bot_b")
NODES = """event long, head string, parent_id string, top_id string, bot_id string, bot_layer int, step int, sx double, sy double, depth int,
n_angles int, quad double, path array<string>, layers int, top_a string, top_b string, bot_a string, bot_b string"""
NODE_SCHEMA = pa.schema([("event", pa.int64()), *[(c, pa.string()) for c in ("head", "parent_id", "top_id", "bot_id")], ("bot_layer", pa.int32()), ("step", pa.int32()), ("sx", pa.float64()), ("sy", pa.float64()), ("depth", pa.int32()), ("n_angles", pa.int32()), ("quad", pa.float64()), ("path", pa.list_(pa.string())), ("layers", pa.int32()), *[(c, pa.string()) for c in ("top_a", "top_b", "bot_a", "bot_b")]])


def grow(links: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """links: event, top_layer, bot_layer, step, top_id, bot_id, sx, sy, top_a, top_b, bot_a, bot_b and, if there are such, wide_a,
    wide_b (widths of the lower point's clusters) and gap (skipped layers lie in a gap). The nodes of all trees.

    From the top layer down, and in a layer by id, each point's links are attached to the best node that ends there: those of more
    than three angles before those of two, then the least root of the summed squared displacements over their number. A point
    where none fits starts a tree, unless it is second in a chain of links or lies on clusters of longer trees; trees don't begin
    with a link over three layers or more outside of gaps. A link is refused where one of its clusters belongs to a much longer or
    much straighter node (an owner is never evicted). Once links are attached, all other nodes that end at the point are deleted;
    where no link starts, all but the best are. Events come as lists of links, 64 to a turn of the worker. depth: links from the head; path: points from the head down to the node's.
    """
    has = set(links.columns)
    rows = links.withColumns({c: F.lit(v) for c, v in {"wide_a": 1, "wide_b": 1, "gap": False}.items() if c not in has}).select(*Link._fields)

    def told(lists: pa.RecordBatch) -> pa.RecordBatch:
        links_, held = lists.column("links"), []
        each = zip(*[c.to_pylist() for c in links_.flatten().flatten()], strict=True)
        for event, n in zip(lists.column("event").to_pylist(), pc.list_value_length(links_).to_pylist(), strict=True):
            found = sorted((Link(event, *row) for row in islice(each, n)), key=lambda x: (-x.top_layer, x.top_id, x.step, x.bot_id))
            for node in grow_event(found, cuts):
                k, parent = node.link, node.parent.link.top_id if node.parent else None
                held.append((k.event, node.path[0], parent, k.top_id, k.bot_id, k.bot_layer, k.step, k.sx, k.sy, node.depth, node.depth - 1, node.quad, node.path, node.layers, k.top_a, k.top_b, k.bot_a, k.bot_b))
        columns = list(zip(*held, strict=True)) or [()] * len(NODE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_SCHEMA, strict=True)], schema=NODE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                yield told(batch.slice(k, 64))

    lists = rows.groupBy("event").agg(F.collect_list(F.struct(*Link._fields[1:])).alias("links"))
    return lists.mapInArrow(run, NODES)


def statistics(nodes: DataFrame) -> DataFrame:
    """Nodes with leaves, branches, depth below (1 at a leaf), and the points and straightness of their best leaf.

    A child is better if it is deeper, then if its best leaf is straighter, so the best leaf of a node is the straightest of its
    deepest ones. Each leaf goes to all nodes on its path. A branch is a node below with exactly three levels: the first of a
    run that is deeper than two.
    """
    rms = F.when(F.col("n_angles") > 0, F.sqrt("quad") / F.col("n_angles")).otherwise(0.0)
    parents = nodes.filter("parent_id IS NOT NULL").select("event", F.col("parent_id").alias("top_id"), F.col("top_id").alias("bot_id")).distinct()
    leaves = nodes.join(parents, ["event", "top_id", "bot_id"], "left_anti").select("event", "path", rms.alias("rms"))
    above = lambda path: F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: F.struct(F.get(path, k - 1).alias("top_id"), F.get(path, k).alias("bot_id"), (F.size(path) - k).alias("below")))
    each = leaves.select("event", "path", "rms", F.explode(above(F.col("path"))).alias("at")).select("event", "path", "rms", "at.*")
    best = F.min(F.struct((-F.col("below")).alias("a"), F.round("rms", 9).alias("b"), F.col("path"), F.col("rms"))).alias("best")
    sums = each.groupBy("event", "top_id", "bot_id").agg(F.count("*").alias("n_leaves"), F.max("below").alias("below"), best)
    found = nodes.join(sums, ["event", "top_id", "bot_id"])
    third = found.filter("below = 3 AND depth > 1").select("event", F.explode(above(F.slice("path", 1, F.size("path") - 1))).alias("at")).groupBy("event", "at.top_id", "at.bot_id").agg(F.count("*").alias("n_branches"))
    found = found.join(third, ["event", "top_id", "bot_id"], "left")
    return found.select(*NODE, "n_leaves", F.coalesce("n_branches", F.lit(0)).alias("n_branches"), "below", F.size("best.path").alias("most_points"), F.col("best.rms").alias("best_rms"), F.col("best.path").alias("best_path"))


def kept(stats: DataFrame, least_cosine: float = 0.975, least_depth: int = 3) -> DataFrame:
    """The nodes of statistics() that stay, with main: the path of their tree's best leaf.

    Of a head's links those that nothing hangs on go if they turn away from its best link (T6). Then the heads of an event are
    taken in the order in which they grew; one stays if its tree has `least_depth` levels, its own included, and its point lies on no
    cluster of a tree that is there then: a node over more than two layers in view a, or with more than two links in view b (T7).
    Trees that went leave their clusters free to later ones. Null clusters are on no tree.
    """
    first = stats.filter("parent_id IS NULL")
    better = F.struct((-F.col("below")).alias("a"), F.round("best_rms", 9).alias("b"), "bot_id", "sx", "sy", "below", (F.col("bot_layer") + F.col("step")).alias("top_layer"), "top_a", "top_b", "best_path")
    heads = first.groupBy("event", "head").agg(F.min(better).alias("best"))
    order = Window.partitionBy("event").orderBy(F.desc("best.top_layer"), "head")
    heads = heads.select("event", "head", "best", F.row_number().over(order).alias("place"))
    rows = stats.join(heads, ["event", "head"])
    dot = F.col("sx") * F.col("best.sx") + F.col("sy") * F.col("best.sy") + 1
    size = lambda x, y: F.sqrt(x * x + y * y + 1)
    cosine = F.round(dot / size(F.col("sx"), F.col("sy")) / size(F.col("best.sx"), F.col("best.sy")), 9)
    stub = F.col("parent_id").isNull() & (F.col("below") == 1) & (F.col("bot_id") != F.col("best.bot_id")) & (cosine < least_cosine)
    rows = rows.withColumn("stub", stub)
    own = heads.select("event", F.col("head").alias("own"), "place", *[F.col(f"best.top_{v}").alias(v) for v in "ab"])
    on = lambda v, far: rows.filter(far).select("event", F.col(f"bot_{v}").alias(v), F.struct(F.col("place").alias("place"), F.col("stub").alias("stub")).alias("rival")).join(own, ["event", v]).select("event", "own", "rival")
    rivals = on("a", F.col("layers") > 2).unionByName(on("b", F.col("depth") > 2)).groupBy("event", F.col("own").alias("head")).agg(F.collect_set("rival").alias("rivals"))
    asked = heads.join(rivals, ["event", "head"], "left").select("event", F.struct("place", "head", (F.col("best.below") + 1 >= least_depth).alias("deep"), "rivals").alias("h"))

    def step(acc: Column, h: Column) -> Column:
        there = lambda r: (r["place"] >= h["place"]) | (~r["stub"] & F.array_contains(acc, r["place"]))
        stays = h["deep"] & ~F.coalesce(F.exists(h["rivals"], there), F.lit(False))
        return F.when(stays, F.concat(acc, F.array(h["place"]))).otherwise(acc)

    stay = asked.groupBy("event").agg(F.aggregate(F.array_sort(F.collect_list("h")), F.array().cast("array<int>"), step).alias("stay"))
    out = rows.join(stay, "event").filter(F.array_contains("stay", F.col("place")) & ~F.col("stub"))
    return out.select(*stats.columns, F.col("best.best_path").alias("main"))


def main_distance() -> Column:
    """Of a node of kept(): how many nodes its path has beside the main one."""
    same = F.filter(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k) == F.slice("main", F.lit(1), k))
    return F.size("path") - F.size(same)


def ordered_leaves(nodes: DataFrame) -> DataFrame:
    """event, head, leaf, distance, rms, rank: the leaves of kept trees, the main one first, then those that leave it furthest, then the
    straightest over the layers that they span; ties by leaf, then by path (two leaves of a tree may end at one point)."""
    leaves = nodes.filter("below = 1").select("event", "head", F.col("bot_id").alias("leaf"), main_distance().alias("distance"), F.round(F.col("best_rms") * F.col("layers"), 9).alias("rms"), "path")
    order = Window.partitionBy("event", "head").orderBy(F.desc(F.when(F.col("distance") == 0, 100000).otherwise(F.col("distance"))), "rms", "leaf", "path")
    return leaves.withColumn("rank", F.row_number().over(order).cast("long")).drop("path")


def ranked_leaves(stats: DataFrame, least_unique: int = 2) -> DataFrame:
    """event, head, leaf, rank, n_points, n_shared, accepted: the leaves of each tree, longest first, then straightest.
    Ties go by leaf, then by path, as two leaves of a tree may end at one point.

    n_shared: points that the leaf has in common with the best one. The best leaf is accepted, and another one if more than
    `least_unique` of its points are its own.
    """
    leaves = stats.filter("below = 1").select("event", "head", F.col("bot_id").alias("leaf"), "path", F.size("path").alias("n_points"), F.col("best_rms").alias("rms"))
    order = Window.partitionBy("event", "head").orderBy(F.desc("n_points"), F.round("rms", 9), "leaf", "path")
    ranked = leaves.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("best", F.first("path").over(order))
    shared = F.size(F.array_intersect("path", "best"))
    return ranked.withColumn("n_shared", shared).withColumn("accepted", (F.col("rank") == 1) | (F.col("n_points") - F.col("n_shared") > least_unique))


def leaf_hits(leaves: DataFrame, points: DataFrame) -> DataFrame:
    """event, head, leaf, layer, point_id, x, y, gap: the points of each leaf from the head down; skipped layers come as gap hits on the straight line between."""
    at = leaves.select("event", "head", "leaf", "path", F.explode("path").alias("point_id"))
    p = points.select("event", F.col("id").alias("point_id"), "layer", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    real = at.join(p, ["event", "point_id"])
    below = Window.partitionBy("event", "head", "leaf", "path").orderBy(F.desc("layer"))
    step = real.withColumns({f"next_{c}": F.lead(c).over(below) for c in ("layer", "x", "y")})
    skipped = step.filter("layer - next_layer > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("layer") - F.col("next_layer") - 1)))
    share = F.col("k") / (F.col("layer") - F.col("next_layer"))
    between = {c: F.col(c) + (F.col(f"next_{c}") - F.col(c)) * share for c in "xy"}
    gaps = skipped.select("event", "head", "leaf", (F.col("layer") - F.col("k")).alias("layer"), F.lit(None).cast(real.schema["point_id"].dataType).alias("point_id"), *[v.alias(c) for c, v in between.items()], F.lit(True).alias("gap"))
    return real.select("event", "head", "leaf", "layer", "point_id", "x", "y", F.lit(False).alias("gap")).unionByName(gaps)
