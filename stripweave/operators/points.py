"""Points from X and Y hits, and neighbours of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut_lineage


def points(hits: DataFrame, keys: list[str], ident: list[str]) -> DataFrame:
    """Every X hit with every Y hit of the same keys (event, layer, tower): one equi-join, no cross product."""
    x = hits.filter("view = 0").select(*keys, F.col("strip").alias("x"), *[F.col(c).alias(f"x_{c}") for c in ident])
    y = hits.filter("view = 1").select(*keys, F.col("strip").alias("y"), *[F.col(c).alias(f"y_{c}") for c in ident])
    return x.join(y, keys)


def pair_id(x_hit: str, y_hit: str) -> Column:
    """A point's id: the ids of both hits, told apart whatever their size."""
    return F.concat_ws(":", F.col(x_hit).cast("string"), F.col(y_hit).cast("string"))


def nearest(queries: DataFrame, others: DataFrame, keys: list[str], distance: Column, ok: Column, tie: list[str], ident: list[str], take: int = 1) -> DataFrame:
    """For each query (ident) the `take` nearest acceptable rows with equal keys, ties by id; n_near counts the acceptable ones."""
    pairs = queries.join(others, keys).withColumn("distance", distance).filter(ok)
    by = Window.partitionBy(*ident)
    return pairs.withColumn("n_near", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("distance", *tie))).filter(F.col("rank") <= take)


def nearest_later(points_: DataFrame, digits: int = 6, crowd: int = 64, halvings: int = 24) -> DataFrame:
    """points: grp, id, x, y, z, ids unique. grp, first, second, doca: of each point the nearest of its group with a greater id, by the
    distance rounded to `digits`; ties by id. Points without a later one have no row.

    Points are compared with those of the cells around theirs. The cells' width starts where none holds more than `crowd` points and doubles for
    those points that found none within it, until a cell holds the whole group; later turns only take the points behind the
    first one that still looks. A point of which few are later looks further, but there are few such points, so the pairs
    grow about with the points. Points at one place, or nearer than the rounding tells, are all compared with each other.
    Rows without a group or a coordinate have no partner. Many near copies cost more turns, at most `halvings`.
    """
    has = points_.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz") + " AND grp IS NOT NULL").select("grp", "id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    rows = cut_lineage(has)
    reach = rows.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))]).first()
    if reach["lowx"] is None:
        return rows.select("grp", F.col("id").alias("first"), F.col("id").alias("second"), F.lit(0.0).alias("doca")).limit(0)
    whole = max(*[reach[f"high{c}"] - reach[f"low{c}"] for c in "xyz"], 10.0**-digits) * 2
    at = lambda width: [F.floor((F.col(c) - reach[f"low{c}"]) / width).alias(f"c{c}") for c in "xyz"]
    cell, turns = ["grp", "cx", "cy", "cz"], 0
    least = 10.0**-digits * 4
    while turns < halvings and whole / 2 ** (turns + 1) > least and rows.groupBy("grp", *at(whole / 2**turns)).count().filter(F.col("count") > crowd).limit(1).count():
        turns += 1
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    d2 = sum(((F.col(c) - F.col(f"o{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("ox")) ** 2)
    last = rows.groupBy("grp").agg(F.max("id").alias("last"))
    looking = rows.join(last, "grp").filter("id < last").drop("last")
    done = []
    for turn in range(turns, -1, -1):
        width = whole / 2**turn
        beside = F.explode(F.array(*[F.struct(*[(F.col(f"c{c}") + d).alias(f"c{c}") for c, d in zip("xyz", o, strict=True)]) for o in around])).alias("to")
        a = looking.select("grp", F.col("id").alias("first"), "x", "y", "z", *at(width)).select("grp", "first", "x", "y", "z", beside).select("grp", "first", "x", "y", "z", "to.*")
        others = rows
        if turn < turns:
            others = rows.join(looking.groupBy("grp").agg(F.min("id").alias("from")), "grp").filter("id > from").drop("from")
        b = others.select("grp", *at(width), F.col("id").alias("second"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
        near = a.join(b, cell).filter("first < second").withColumn("doca", F.round(F.sqrt(d2), digits))
        found = near.groupBy("grp", "first").agg(F.min(F.struct("doca", "second")).alias("best")).select("grp", "first", "best.second", "best.doca")
        sure = found if turn == 0 else found.filter(F.col("doca") < width - 2 * 10.0**-digits)  # no point beyond the cells around can be as near, or tie
        sure = cut_lineage(sure)
        done.append(sure)
        if turn:
            looking = cut_lineage(looking.join(sure.select("grp", F.col("first").alias("id")), ["grp", "id"], "left_anti"))
            if not looking.limit(1).count():
                break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def layer_statistics(points_: DataFrame, skip: int) -> DataFrame:
    """Of each event: points, layers with points, and the most link combinations over up to skip + 1 layers."""
    per_layer = points_.groupBy("event", "layer").agg(F.count("*").alias("n"))
    below = per_layer.select("event", (F.col("layer")).alias("below"), F.col("n").alias("m"))
    steps = per_layer.withColumn("below", F.explode(F.array(*[F.col("layer") - k for k in range(1, skip + 2)])))
    links = steps.join(below, ["event", "below"]).groupBy("event").agg(F.sum(F.col("n") * F.col("m")).alias("n_links"))
    sums = per_layer.groupBy("event").agg(F.sum("n").alias("n_points"), F.count("*").alias("n_layers"))
    return sums.join(links, "event", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
