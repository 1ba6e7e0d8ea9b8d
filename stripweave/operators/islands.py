"""Gaps and islands: runs of strips, merging of neighbours in truncated planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], first: str, last: str, most: Column | int, tie: list[str]) -> DataFrame:
    """Adds island: rows of a group, by first, belong together while the gap to the last strip so far is at most `most`."""
    order = Window.partitionBy(*by).orderBy(first, *tie)
    before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col(first) - before > most), 1).otherwise(0)
    return rows.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each island: ends, mean of the end positions, status bits or-ed, the signal of the first member by strip, then by
    price, part, supplier and width."""
    return rows.groupBy(*by, "island").agg(
        F.count("*").alias("n_members"),
        F.min("strip").alias("first_strip"),
        F.max("last_strip").alias("last_strip"),
        F.expr("bit_or(status)").alias("status"),
        F.min_by("width", F.struct("strip", "price", "part", "supp", "width")).alias("signal"),
    ).withColumn("position", (F.col("first_strip") + F.col("last_strip")) / 2)


def allowed_gap(rows: DataFrame, by: list[str], truncated: Column, tie: list[str], least: int = 3, most: int = 10, none: int = 5000) -> DataFrame:
    """Merge threshold of a plane (by: its keys; side: 0 or 1 of its read-out): the smaller of its sides' average gaps, rounded, plus one, inside [least, most].

    A side without gaps counts as `none`, so a plane without any gets `most`. truncated: an aggregate; planes where it is false get 0.
    """
    order = Window.partitionBy(*by, "side").orderBy("strip", *tie)
    gaps = rows.withColumn("gap", F.col("strip") - F.lag("strip").over(order))
    mean = lambda side: F.coalesce(F.floor(F.avg(F.when(F.col("side") == side, F.col("gap"))) + 0.5), F.lit(none))
    sides = gaps.groupBy(*by).agg(mean(0).alias("low"), mean(1).alias("high"), truncated.alias("truncated"))
    inside = F.greatest(F.lit(least), F.least(F.lit(most), F.least("low", "high") + 1))
    return sides.select(*by, F.when(F.col("truncated"), inside).otherwise(0).cast("int").alias("allowed"))
