"""Links between points of near layers: the layer offset is exploded, so the join is an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import LAYER_PITCH, STRIP_PITCH


def links(points: DataFrame, skip: int, band: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """points: event, layer, x, y, id, more. Columns top_*, bot_*, step (1 .. skip + 1).

    band: condition on those columns, such as a greatest transverse distance.
    """
    columns = ("layer", "x", "y", "id", *more)
    top = points.select("event", *[F.col(c).alias(f"top_{c}") for c in columns])
    top = top.withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, skip + 2)]))).withColumn("bot_layer", F.col("top_layer") - F.col("step"))
    bot = points.select("event", *[F.col(c).alias(f"bot_{c}") for c in columns])
    joined = top.join(bot, ["event", "bot_layer"])
    return joined if band is None else joined.filter(band)


def transverse() -> Column:
    return F.sqrt((F.col("top_x") - F.col("bot_x")) ** 2 + (F.col("top_y") - F.col("bot_y")) ** 2)


def chains(links_: DataFrame, cosine: Column | None = None) -> DataFrame:
    """Pairs of links that share a point: the upper link's bottom is the lower link's top."""
    upper = links_.select("event", *[F.col(c).alias(f"u_{c}") for c in links_.columns if c != "event"])
    lower = links_.select("event", *[F.col(c).alias(f"w_{c}") for c in links_.columns if c != "event"]).withColumn("u_bot_id", F.col("w_top_id"))
    return upper.join(lower, ["event", "u_bot_id"])


def paths(links_: DataFrame, depth: int) -> DataFrame:
    """All chains of at least two links as (event, head, tail, n_links), each down to its dead end or `depth` links.

    One equi-join for each step and no recursion limit. A chain at its dead end finds no link and stays as it is.
    """
    step = links_.select("event", F.col("top_id").alias("from_id"), F.col("bot_id").alias("to_id"))
    ahead = step.select("event", F.col("from_id").alias("tail"), F.col("to_id").alias("next"))
    now = step.select("event", F.col("from_id").alias("head"), F.col("to_id").alias("tail"), F.lit(1).alias("n_links"))
    for _ in range(depth - 1):
        more = F.when(F.col("next").isNotNull(), 1).otherwise(0)
        now = now.join(ahead, ["event", "tail"], "left").select("event", "head", F.coalesce("next", "tail").alias("tail"), (F.col("n_links") + more).alias("n_links"))
    return now.filter("n_links >= 2")


def gated(links_: DataFrame, position: DataFrame, tolerance: float, tight: float) -> DataFrame:
    """position: event, cx, cy, cz in mm. Adds doca (closest approach of the link's line to it), kept and tight."""
    rows = links_.join(position, "event")
    d = [(F.col("top_x") - F.col("bot_x")) * STRIP_PITCH, (F.col("top_y") - F.col("bot_y")) * STRIP_PITCH, F.col("step") * LAYER_PITCH]
    w = [F.col("cx") - F.col("top_x") * STRIP_PITCH, F.col("cy") - F.col("top_y") * STRIP_PITCH, F.col("cz") - F.col("top_layer") * LAYER_PITCH]
    across = [w[1] * d[2] - w[2] * d[1], w[2] * d[0] - w[0] * d[2], w[0] * d[1] - w[1] * d[0]]
    doca = F.sqrt(across[0] ** 2 + across[1] ** 2 + across[2] ** 2) / F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    rows = rows.withColumn("doca", F.round(doca, 6))
    return rows.withColumn("kept", F.col("doca") <= tolerance).withColumn("tight", F.col("doca") < tight)
