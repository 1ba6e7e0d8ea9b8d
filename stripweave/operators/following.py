"""Following tracks through the planes: predict, take the nearest cluster within the prediction's own error, filter, count gaps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folding import let
from ..functions.geometry import LAYER_PITCH, STRIP_PITCH, TRAY_WIDTH


@dataclass(frozen=True)
class Following:
    """Search region in sigmas, gaps and gaps in a row, steepest slope, least hits, resolution and thickness of a
    plane (mm), error of the first slope, variance of the first position; scattering of one layer at an energy (MeV);
    strips of a ladder and extent of the planes (mm)."""

    sigmas: float = 9.0
    gaps: int = 2
    gaps_in_a_row: int = 1
    steepest: float = 5.0
    least_hits: int = 5
    least_of_view: int = 2
    resolution: float = 0.066
    thickness: float = 0.4
    slope_error: float = 0.17
    first_variance: float = 5.0
    rad_len: float = 0.03
    energy: float = 1000.0
    ladder: int = 384
    extent: float = 1536 * STRIP_PITCH

    @property
    def noise(self) -> float:
        return (13.6 * math.sqrt(self.rad_len) * (1 + 0.038 * math.log(self.rad_len)) / self.energy) ** 2

    @property
    def unmeasured(self) -> float:
        return TRAY_WIDTH * TRAY_WIDTH / 12


STATE = ("p", "s", "pp", "ps", "ss")  # position, slope, covariances; of view 0 with a, of view 1 with b


def by_plane(clusters: DataFrame) -> DataFrame:
    """event, planes: map of plane to its clusters. The guards of the first pass bound an event's clusters."""
    each = clusters.groupBy("event", "plane").agg(F.collect_list(F.struct("cluster", "position", "width", "first_strip")).alias("found"))
    return each.groupBy("event").agg(F.map_from_entries(F.collect_list(F.struct("plane", "found"))).alias("planes"))


def nearest(planes: Column, plane: Column, position: Column, slope: Column, variance: Column, f: Following) -> Column:
    """The nearest cluster of a plane within the search region that isn't too narrow for the slope; null if there is none. Ties by cluster."""
    far = F.least(F.lit(f.sigmas) * F.sqrt(variance + (F.lit(f.thickness) * slope) * (F.lit(f.thickness) * slope)), F.lit(TRAY_WIDTH / 4))
    width = F.floor(F.greatest(F.lit(f.thickness) * F.abs(slope) / STRIP_PITCH - 1, F.lit(1.0)))
    edge = lambda c: (c["first_strip"] % f.ladder == 0) | ((c["first_strip"] + c["width"]) % f.ladder == 0)
    here = F.try_element_at(planes, plane)
    near = F.transform(here, lambda c: F.struct(F.abs(c["position"] - position).alias("distance"), c["cluster"].alias("cluster"), c["position"].alias("position"), ((c["width"] >= width) | edge(c)).alias("wide")))
    return F.array_min(F.filter(near, lambda c: c["wide"] & (c["distance"] < far)))


def follow(seeds: DataFrame, clusters: DataFrame, f: Following = Following()) -> DataFrame:
    """seeds: event, track, plane, x, y, sx, sy (mm; slopes are what a position gains a mm upwards). clusters: event, cluster, plane
    (2 * layer + view; view 0 measures x), position (mm), width, first_strip, without those in use.

    event, track, found, hits: array<struct<plane, cluster>> from the top down, cluster null at a gap. A track begins at the nearest
    cluster of its seed's plane. In each plane below it predicts its position; the nearest cluster within the sum of predicted and
    thickness errors, wide enough for the slope or at a ladder's edge, is its hit, and the state is filtered with it. Without one
    the plane is a gap. A track ends before the third gap or the second in a row, at the extent of the planes, or behind a hit
    that makes it too steep; gaps at its end go. found: five hits or more, two in each view. Seeds without a first
    cluster are left out. Each track scatters in every layer; both views of a layer lie at one height.

    One join by event and a fold over the planes of each track inside the engine: no rounds.
    """
    layer = lambda k: F.floor(k / 2)
    seeds = seeds.select("event", "track", F.col("plane").cast("int").alias("plane"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "sx", "sy")])
    rows = seeds.join(by_plane(clusters), "event")
    at_x = F.col("plane") % 2 == 0
    first = nearest(F.col("planes"), F.col("plane"), F.when(at_x, F.col("x")).otherwise(F.col("y")), F.when(at_x, F.col("sx")).otherwise(F.col("sy")), F.lit(f.first_variance), f)
    rows = rows.withColumn("first", first).filter("first IS NOT NULL")
    measured, free = f.resolution * f.resolution, f.unmeasured
    state = {"ap": F.col("x"), "as": F.col("sx"), "app": F.when(at_x, measured).otherwise(free), "aps": F.lit(0.0), "ass": F.lit(f.slope_error**2)}
    state |= {"bp": F.col("y"), "bs": F.col("sy"), "bpp": F.when(at_x, free).otherwise(measured), "bps": F.lit(0.0), "bss": F.lit(f.slope_error**2)}
    counts = {"on": F.lit(True), "gaps": F.lit(0), "row": F.lit(0), "n_a": at_x.cast("int"), "n_b": (~at_x).cast("int"), "last": F.col("plane")}
    hit = F.struct(F.col("plane").alias("plane"), F.col("first.cluster").alias("cluster"))
    start = F.struct(*[v.alias(c) for c, v in (state | counts).items()], F.array(hit).alias("hits"))

    def predicted(acc: Column, k: Column) -> Column:
        dz = (layer(acc["last"]) - layer(k)) * F.lit(LAYER_PITCH)
        noise = F.when(dz > 0, F.lit(f.noise)).otherwise(0.0)
        out = []
        for v in "ab":
            p, s, pp, ps, ss = (acc[v + c] for c in STATE)
            out += [(p - s * dz).alias(v + "p"), s.alias(v + "s"), (pp - 2 * dz * ps + dz * dz * ss).alias(v + "pp"), (ps - dz * ss).alias(v + "ps"), (ss + noise).alias(v + "ss")]
        return F.struct(*out)

    def with_cluster(acc: Column, k: Column, q: Column) -> Column:
        at_a = k % 2 == 0
        of = lambda c: F.when(at_a, q["a" + c]).otherwise(q["b" + c])
        return let(nearest(F.col("planes"), k, of("p"), of("s"), of("pp"), f), lambda c: after(acc, k, q, c))

    def after(acc: Column, k: Column, q: Column, c: Column) -> Column:
        out: dict[str, Column] = {}
        hits_it = c.isNotNull()
        for v, mine in (("a", k % 2 == 0), ("b", k % 2 == 1)):
            p, s, pp, ps, ss = (q[v + x] for x in STATE)
            takes, whole, off = mine & hits_it, pp + F.lit(measured), c["position"] - p
            new = {"p": p + pp / whole * off, "s": s + ps / whole * off, "pp": pp - pp * pp / whole, "ps": ps - pp * ps / whole, "ss": ss - ps * ps / whole}
            out |= {v + x: F.when(takes, new[x]).otherwise(q[v + x]) for x in STATE}
            out["n_" + v] = acc["n_" + v] + takes.cast("int")
        gaps, row = acc["gaps"] + (~hits_it).cast("int"), F.when(hits_it, 0).otherwise(acc["row"] + 1)
        inside = (q["ap"] >= 0) & (q["ap"] <= f.extent) & (q["bp"] >= 0) & (q["bp"] <= f.extent)
        goes_on = inside & (gaps <= f.gaps) & (row <= f.gaps_in_a_row)
        grown = F.concat(acc["hits"], F.array(F.struct(k.cast("int").alias("plane"), c["cluster"].alias("cluster"))))
        steep = hits_it & ((F.abs(out["as"]) > f.steepest) | (F.abs(out["bs"]) > f.steepest))
        told = {**out, "on": ~steep, "gaps": gaps, "row": row, "last": k.cast("int")}
        new = F.struct(*[told[x].alias(x) for x in (*state, *counts)], grown.alias("hits"))
        ended = F.struct(*[F.lit(False).alias(x) if x == "on" else acc[x].alias(x) for x in (*state, *counts)], acc["hits"].alias("hits"))
        return F.when(goes_on, new).otherwise(ended)

    def step(acc: Column, k: Column) -> Column:
        return F.when(acc["on"], let(predicted(acc, k), lambda q: with_cluster(acc, k, q))).otherwise(acc)

    planes = F.when(F.col("plane") > 0, F.sequence(F.col("plane") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("end", F.aggregate(planes, start, step))
    last = F.array_max(F.transform(F.col("end.hits"), lambda h, k: F.when(h["cluster"].isNotNull(), k + 1)))
    found = (F.col("end.n_a") + F.col("end.n_b") >= f.least_hits) & (F.least("end.n_a", "end.n_b") >= f.least_of_view)
    return rows.select("event", "track", found.alias("found"), F.slice("end.hits", F.lit(1), last).alias("hits"))
