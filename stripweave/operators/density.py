"""Clusters of points: bins that touch, spanning forests, cuts of long edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, cut_lineage

#: Fixed values by decade of the number of links, 1 to 6: bin size (mm), separation in bins, least points.
BIN_SIZES, SEPARATIONS, LEAST_POINTS = (15.0, 15.0, 12.0, 12.0, 10.0, 20.0), (8, 6, 6, 5, 4, 2), (2, 3, 5, 8, 10, 10)


def bin_parameters(n: Column) -> tuple[Column, Column, Column]:
    """Bin size, separation and least points for n links, n at least 1."""
    decade = F.greatest(F.lit(1), F.least(F.lit(6), F.floor(F.log10(n) + 0.5))).cast("int")
    return tuple(F.element_at(F.array(*map(F.lit, values)), decade) for values in (BIN_SIZES, SEPARATIONS, LEAST_POINTS))


def bin_clusters(bins: DataFrame, separation: int, least_points: int) -> DataFrame:
    """bins: grp, bx, by_, bz, n, layers (bits). Adds label: bins of one cluster; null for noise.

    Bins nearer than `separation` on every axis are neighbours. A bin is noise if its neighbours hold fewer than `least_points`
    points and it spans fewer than two layers. Other bins merge on contact. Neighbours are found by equi-joins on coarse cells.
    """
    axes = ("bx", "by_", "bz")
    rows = bins.withColumn("id", F.concat_ws(":", *[F.col(c).cast("string") for c in ("grp", *axes)]))
    cells = {f"c_{c}": F.floor(F.col(c) / separation).cast("int") for c in axes}
    a = rows.select("grp", "id", *axes).withColumns(cells)
    for c in axes:
        a = a.withColumn(f"c_{c}", F.explode(F.array(*[F.col(f"c_{c}") + k for k in (-1, 0, 1)])))
    b = rows.withColumns(cells).select("grp", *cells, F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in axes], F.col("n").alias("m"))
    near = a.join(b, ["grp", *cells]).filter("id <> other")
    for c in axes:
        near = near.filter(F.abs(F.col(c) - F.col(f"o_{c}")) < separation)
    around = near.groupBy("id").agg(F.sum("m").alias("around"))
    marked = rows.join(around, "id", "left").withColumn("noise", (F.coalesce("around", F.lit(0)) < least_points) & (F.bit_count("layers") < 2))
    marked = cut_lineage(marked)
    core = marked.filter("NOT noise").select("id")
    edges = near.select("id", "other").filter("id < other").join(core, "id").join(core.withColumnRenamed("id", "other"), "other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    return marked.join(components(core, edges), "id", "left").drop("noise", "around")


def spanning_forest(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """nodes: id; edges: a, b, w. a, b, w of the lightest forest: each round every tree takes its lightest edge to another tree.

    Ties fall by (a, b), so the forest is unique. The number of trees at least halves in a round. Edges to ids that are no nodes are left out.
    """
    known = edges
    for c in "ab":
        known = known.join(nodes.select(F.col("id").alias(c)).distinct(), c, "left_semi")
    found = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a < b").withColumns({"la": F.col("a"), "lb": F.col("b")})
    return joined_trees(found, most_rounds)[0]


def joined_trees(edges: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """edges: la, lb (two trees), a, b, w. The edges that join trees at the least weight (a, b, w), and label, root: the trees that were joined.

    Each round every tree takes its lightest edge, ties by (a, b), so that only two trees can choose each other; the lesser of them is the
    root of all that hang on it, found by doubling. Then edges are kept between roots alone, one for each pair.
    """
    lightest = F.min(F.struct("w", "a", "b")).alias("e")
    cross = lambda e: cut_lineage(e.filter("la <> lb").groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).agg(lightest).select("la", "lb", "e.*"))
    edges = cross(edges)
    taken = [edges.select("a", "b", "w").limit(0)]
    roots = edges.select(F.col("la").alias("label"), F.col("la").alias("root")).limit(0)
    for number in range(most_rounds):
        if not edges.limit(1).count():
            break
        ends = [edges.select(F.col(own).alias("label"), F.struct("w", "a", "b", F.col(other).alias("other")).alias("e")) for own, other in (("la", "lb"), ("lb", "la"))]
        best = cut_lineage(ends[0].unionByName(ends[1]).groupBy("label").agg(F.min("e").alias("e")).select("label", "e.*"))
        taken.append(best.select("a", "b", "w").distinct())
        mutual = best.select(F.col("other").alias("label"), F.col("label").alias("other"), F.lit(True).alias("mutual"))
        parent = best.join(mutual, ["label", "other"], "left").select("label", F.when(F.col("mutual") & (F.col("label") < F.col("other")), F.col("label")).otherwise(F.col("other")).alias("root"))
        parent = cut_lineage(parent)
        while True:  # each turn follows four times as many steps
            above = parent.select(F.col("label").alias("root"), F.col("root").alias("next"))
            twice = cut_lineage(parent.join(above, "root").select("label", "root", F.col("next").alias("far")))
            if not twice.filter("far <> root").limit(1).count():
                break
            above = twice.select(F.col("label").alias("root"), F.col("far").alias("next"))
            parent = cut_lineage(twice.select("label", F.col("far").alias("root")).join(above, "root").select("label", F.col("next").alias("root")))
        if number:
            old = roots.join(parent.select(F.col("label").alias("root"), F.col("root").alias("new")), "root", "left").select("label", F.coalesce("new", "root").alias("root"))
            roots = cut_lineage(old)
        else:
            roots = parent
        for end in ("la", "lb"):
            edges = edges.join(parent.select(F.col("label").alias(end), F.col("root").alias("new")), end).drop(end).withColumnRenamed("new", end)
        edges = cross(edges)
    else:
        raise RuntimeError(f"the forest did not settle in {most_rounds} rounds")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return cut_lineage(out), roots


def near_forest(points: DataFrame, size: float, crowd: int = 64, halvings: int = 24) -> DataFrame:
    """points: grp, id, x, y, z, ids unique. a, b, w: the lightest forest over the points of a group that are no further than `size` apart,
    ties by (a, b), as spanning_forest finds it over all such pairs, without forming them.

    Points at one place hang on the least of them by edges of 0, and only that one is compared. The distance then grows by doubling, from
    one at which no cell of that width holds more than `crowd` points: all edges of up to a distance are taken before longer ones, and a
    longer one can only join two trees. So from the second distance on a cell takes part only if it or a neighbour holds another tree,
    and only pairs of two trees are kept, the lightest of two trees alone: work grows with the points and the seams between trees.
    Rows without a group or a coordinate have no edges. Many near copies cost more turns, one for each doubling, at most `halvings`.
    """
    has = points.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz") + " AND grp IS NOT NULL").select("grp", "id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    places = cut_lineage(has.groupBy("grp", "x", "y", "z").agg(F.min("id").alias("id"), F.collect_set("id").alias("ids")))
    copies = places.filter(F.size("ids") > 1).select(F.col("id").alias("a"), F.explode("ids").alias("b"), F.lit(0.0).alias("w")).filter("a <> b")
    now = places.select("grp", "id", "x", "y", "z", F.col("id").alias("label"))
    at = lambda width: [F.floor(F.col(c) / width).alias(f"c{c}") for c in "xyz"]
    cell, turns = ["grp", "cx", "cy", "cz"], 0
    while turns < halvings and now.groupBy("grp", *at(size / 2**turns)).count().filter(F.col("count") > crowd).limit(1).count():
        turns += 1
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    beside = lambda offsets: F.explode(F.array(*[F.struct(*[(F.col(f"c{c}") + d).alias(c) for c, d in zip("xyz", o, strict=True)], F.lit(o == (0, 0, 0)).alias("own")) for o in offsets])).alias("to")
    moved = [F.col(f"to.{c}").alias(f"c{c}") for c in "xyz"]
    taken = [copies]
    for turn in range(turns, -1, -1):
        width = size / 2**turn
        rows = now.select("*", *at(width))
        if turn < turns:
            held = rows.groupBy(*cell).agg(F.min("label").alias("low"), F.max("label").alias("high"))
            near = held.select("grp", "low", "high", *cell[1:], beside(around)).select("grp", "low", "high", *moved)
            seams = near.groupBy(*cell).agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select(*cell)
            rows = cut_lineage(rows.join(seams, cell, "left_semi"))
        one = rows.select("grp", "id", "x", "y", "z", "label", *cell[1:], beside([o for o in around if o >= (0, 0, 0)])).select("grp", "id", "x", "y", "z", "label", "to.own", *moved)
        two = rows.select(*cell, F.col("id").alias("other"), F.col("label").alias("lb"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
        d2 = sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("ox")) ** 2)
        pairs = one.join(two, cell).filter("label <> lb AND (NOT own OR id < other)").withColumn("d2", d2).withColumn("w", F.sqrt("d2")).filter((F.col("d2") <= size * size) & (F.col("w") <= width))
        found, roots = joined_trees(pairs.select(F.col("label").alias("la"), "lb", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "w"))
        taken.append(found)
        if turn:
            now = cut_lineage(now.join(roots, "label", "left").select("grp", "id", "x", "y", "z", F.coalesce("root", "label").alias("label")))
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def trees_of(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """id, label, size, rank: the trees of a forest by size, ties by label."""
    label = components(nodes, forest.select("a", "b"))
    sizes = label.groupBy("label").agg(F.count("*").alias("size"))
    ranked = sizes.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("size"), "label")))  # one row for each tree
    return label.join(ranked, "label")


def cut_forest(forest: DataFrame, factor: float, least: float) -> DataFrame:
    """The edges that stay when a tree is split at those longer than factor times its mean edge, or `least` if that is more. forest: tree, a, b, w."""
    mean = forest.groupBy("tree").agg(F.avg("w").alias("mean"))
    return forest.join(mean, "tree").filter(F.col("w") <= F.greatest(factor * F.col("mean"), F.lit(least))).drop("mean")
