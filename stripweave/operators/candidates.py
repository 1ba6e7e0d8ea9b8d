"""Bounded sets of candidates without duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidate_set(candidates: DataFrame, share: float = 0.67, most_own: int = 4, most: int = 10) -> DataFrame:
    """candidates: event, candidate, quality, hits (array). event, candidate, place: those that are taken, best first.

    In the order of quality, ties by candidate, one is taken if at least min(share * hits, most_own) of its hits belong to none
    taken before; at most `most` are. The event guard bounds an event's candidates, which are folded inside the engine.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("q"), "candidate", F.array_distinct("hits").alias("hits"))))
    kind = dict(candidates.dtypes)
    start = F.struct(F.array().cast(f"array<{kind['candidate']}>").alias("taken"), F.array().cast(kind["hits"]).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        own = F.size(F.array_except(x["hits"], acc["used"]))
        fits = (own >= F.least(share * F.size(x["hits"]), F.lit(float(most_own)))) & (F.size(acc["taken"]) < most)
        grown = F.struct(F.concat(acc["taken"], F.array(x["candidate"])).alias("taken"), F.array_union(acc["used"], x["hits"]).alias("used"))
        return F.when(fits, grown).otherwise(acc)

    folded = candidates.groupBy("event").agg(ordered.alias("ordered")).select("event", F.aggregate("ordered", start, step)["taken"].alias("taken"))
    return folded.select("event", F.posexplode("taken").alias("place", "candidate"))
