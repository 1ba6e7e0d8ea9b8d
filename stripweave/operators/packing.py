"""Greedy packing of paths into tracks that share no hits but their first ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Packing:
    """First links whose hits may be shared, place until which wide clusters may, most tracks, least links."""

    shared: int = 2
    wide_until: int = 4
    most: int = 11
    least_links: int = 2


def pack(paths: DataFrame, rules: Packing = Packing()) -> DataFrame:
    """paths: event, path_id, rank (place in the event's order, no ties), start_layer, hits: array<struct<a, b, wide>> from the top down,
    a and b the clusters of a point, wide if both are. event, path_id, track: the paths that become tracks, in their order.

    The best path is taken, then the best of those that are left, until `most` are. A taken path rules out all others with
    one of its clusters, but for its first `shared` + 1 points: these only mark the others with their place, and a path may share
    the first point, or the first with others, not a later one alone. Points of wide clusters before place `wide_until` may be
    shared. Of paths of under four links nothing but the first point is shared. A path of fewer links than the longest taken one
    less four, or `least_links`, is passed over if it starts more than two layers below the event's best path.

    One fold over the paths of an event inside the engine: the guards of the first pass bound an event, and no more clusters are
    held than those of `most` tracks. A path without hits is passed over. Null clusters are shared with none.
    """
    kind = dict(paths.dtypes)
    cluster = kind["hits"].split("a:")[1].split(",")[0]
    hits = lambda p, view: F.filter(F.transform(p["hits"], lambda h: h[view]), lambda c: c.isNotNull())
    none = F.array().cast(f"array<{cluster}>")
    marks = [f"mark{k}" for k in range(rules.shared + 1)]
    start = F.struct(F.array().cast(f"array<{kind['path_id']}>").alias("taken"), F.lit(rules.least_links).alias("least"), F.lit(None).cast("int").alias("top"), *[none.alias(c) for name in ("out", *marks) for c in (f"{name}_a", f"{name}_b")])

    def meets(acc: Column, p: Column, name: str) -> Column:
        return F.arrays_overlap(acc[f"{name}_a"], hits(p, "a")) | F.arrays_overlap(acc[f"{name}_b"], hits(p, "b"))

    def step(acc: Column, p: Column) -> Column:
        links = F.size(p["hits"]) - 1
        top = F.coalesce(acc["top"], p["start_layer"])
        first, *later = (meets(acc, p, name) for name in marks)
        wrong = ~first & (later[0] if len(later) == 1 else F.array_contains(F.array(*later), True)) if later else F.lit(False)
        short = (links < acc["least"]) & (p["start_layer"] < top - 2)
        takes = (F.size(acc["taken"]) < rules.most) & (links >= 1) & ~meets(acc, p, "out") & ~wrong & ~short
        shared = F.when(links < 4, 0).otherwise(rules.shared)
        until = F.when(links < 4, 1).otherwise(rules.wide_until)

        def added(name: str, view: str) -> Column:
            kept = lambda h, k: ~((k > shared) & (k < until) & h["wide"]) & h[view].isNotNull()
            here = (lambda h, k: kept(h, k) & (k > shared)) if name == "out" else (lambda h, k: kept(h, k) & (k <= shared) & (k == int(name[4:])))
            return F.concat(acc[f"{name}_{view}"], F.transform(F.filter(p["hits"], here), lambda h: h[view])).alias(f"{name}_{view}")

        grown = F.struct(F.concat(acc["taken"], F.array(p["path_id"])).alias("taken"), F.greatest(acc["least"], links - 4).alias("least"), top.alias("top"), *[added(name, view) for name in ("out", *marks) for view in "ab"])
        passed = F.struct(*[top.alias("top") if c == "top" else acc[c].alias(c) for c in ("taken", "least", "top", *[f"{name}_{view}" for name in ("out", *marks) for view in "ab"])])
        return F.when(takes, grown).otherwise(passed)

    ordered = F.array_sort(F.collect_list(F.struct("rank", "path_id", "start_layer", "hits")))
    folded = paths.groupBy("event").agg(ordered.alias("ordered")).select("event", F.aggregate("ordered", start, step)["taken"].alias("taken"))
    return folded.select("event", F.posexplode("taken").alias("track", "path_id"))
