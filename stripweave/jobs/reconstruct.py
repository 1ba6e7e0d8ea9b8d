"""The first pass as one job: guards, points, links, summaries; refused events go to a side output.

A stage behind the window has empty tables; one before it takes those of an earlier pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import links as lnk
from ..operators import points as pts


POINTS, LINKS, SUMMARY = 1, 2, 3


@dataclass(frozen=True)
class Config:
    """most_points: events of more points aren't searched, decided from counts before any point is formed."""

    most_clusters: int = 2000
    skip: int = 0
    most_d2: int = 250_000
    finder: str = "links"
    most_points: int = 10_000
    first_stage: int = POINTS
    last_stage: int = SUMMARY

    def runs(self, stage: int) -> bool:
        return self.first_stage <= stage <= self.last_stage


@dataclass(frozen=True)
class FirstPass:
    points: DataFrame
    links: DataFrame
    summary: DataFrame
    errors: DataFrame


def link_finder(points: DataFrame, config: Config) -> DataFrame:
    dx, dy = F.col("top_x") - F.col("bot_x"), F.col("top_y") - F.col("bot_y")
    return lnk.links(points, config.skip, dx * dx + dy * dy <= config.most_d2)


#: Finders by name; callers may add their own.
FINDERS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"links": link_finder}


def refused(hits: DataFrame, config: Config) -> DataFrame:
    """event, stage, n_clusters of events with too many clusters or too many points."""
    planes = hits.groupBy("event", "layer").agg(F.count("*").alias("n"), F.count(F.when(F.col("view") == 0, 1)).alias("x"), F.count(F.when(F.col("view") == 1, 1)).alias("y"))
    sizes = planes.groupBy("event").agg(F.sum("n").alias("n_clusters"), F.sum(F.col("x") * F.col("y")).alias("n_points"))
    stage = F.when(F.col("n_clusters") > config.most_clusters, "clusters").when(F.col("n_points") > config.most_points, "points")
    return sizes.withColumn("stage", stage).filter(F.col("stage").isNotNull()).select("event", "stage", "n_clusters")


def first_pass(hits: DataFrame, config: Config = Config(), earlier: FirstPass | None = None) -> FirstPass:
    """hits: event, layer, view, strip, hit. earlier: the pass that ran the stages before the window, if there are any."""
    if config.first_stage > POINTS:
        if earlier is None:
            raise ValueError("a window that doesn't begin with points needs the tables of an earlier pass")
        links = earlier.links if config.first_stage > LINKS else FINDERS[config.finder](earlier.points, config)
        links = links if config.last_stage >= LINKS else links.limit(0)
        return FirstPass(earlier.points, links, summary_of(links, config), earlier.errors)
    errors = refused(hits, config)
    kept = hits.join(errors, "event", "left_anti")
    points = pts.points(kept, ["event", "layer"], ["hit"]).withColumn("id", pts.pair_id("x_hit", "y_hit"))
    points = points if config.runs(POINTS) else points.limit(0)
    found = FINDERS[config.finder](points, config)
    found = found if config.runs(LINKS) else found.limit(0)
    return FirstPass(points, found, summary_of(found, config), errors)


def summary_of(links: DataFrame, config: Config) -> DataFrame:
    summary = links.groupBy("event").agg(F.count("*").alias("n_links"), F.countDistinct("top_layer").alias("n_layers"))
    return summary if config.runs(SUMMARY) else summary.limit(0)
