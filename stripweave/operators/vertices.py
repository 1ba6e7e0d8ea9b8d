"""Vertices of pairs of tracks, chosen greedily: the best partner of the first track is taken, both are used up, and so on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vertexing:
    """Closest approach (mm) at 100 MeV, least quality, height of a tray, reach of a track (mm), the converter above a
    plane, material at the vertex in thick and thin layers (mm), strips of a cluster that may be shared."""

    most_doca: float = 2.0
    least_quality: float = -100.0
    tray: float = 32.575
    reach: float = 37.0
    converter: float = 0.6
    thin_from: int = 6
    material: tuple[float, float] = (0.3, 0.05)
    widest: float = 3.01


ONE, TWO, CROSS, STAGGERED, WIDE, DOCA = 1, 2, 4, 8, 16, 32
TRACK = ("track", "layer", "cluster", "width", "energy", "chi2", "z", "xp", "xs", "xpp", "xps", "xss", "yp", "ys", "ypp", "yps", "yss")

PAIR = "event long, first int, second int, quality double, doca double, z double, status int"


def judged(p: pd.DataFrame, rules: Vertexing) -> pd.DataFrame:
    """The pairs of a batch that may be a vertex; columns of the first track end in 1, of the second in 2."""
    with np.errstate(all="ignore"):
        at = [np.stack([p[f"xp{k}"], p[f"yp{k}"], p[f"z{k}"]], 1) for k in "12"]
        along = [np.stack([-p[f"xs{k}"], -p[f"ys{k}"], np.full(len(p), -1.0)], 1) for k in "12"]
        along = [d / np.linalg.norm(d, axis=1)[:, None] for d in along]
        between, cosine = at[1] - at[0], (along[0] * along[1]).sum(1)
        w1, w2 = ((between * d).sum(1) for d in along)
        sine, parallel = 1 - cosine**2, 1 - cosine**2 < 1e-12
        s1, s2 = np.where(parallel, w1, (w1 - cosine * w2) / sine), np.where(parallel, 0.0, (cosine * w1 - w2) / sine)
        ends = at[0] + s1[:, None] * along[0], at[1] + s2[:, None] * along[1]
        doca, middle = np.linalg.norm(ends[0] - ends[1], axis=1), (ends[0][:, 2] + ends[1][:, 2]) / 2
        z1, z2 = p["z1"].to_numpy(), p["z2"].to_numpy()
        same = (p["cluster1"] == p["cluster2"]).to_numpy() & p["cluster1"].notna().to_numpy()
        narrow = p["width1"].to_numpy() * np.abs(along[0][:, 2]) < rules.widest
        above = ~same & (middle > z1) & (middle - z1 < rules.tray)
        z = np.where(same & narrow, z1 + rules.converter, np.where(above, middle, z1))
        status = TWO + CROSS * ((s1 > 0) & (s2 > 0) & ~same) + STAGGERED * ((np.abs(z1 - z2) > rules.tray / 2) & ~same) + WIDE * (same & ~narrow) + DOCA * above
        material = np.where(p["layer1"] < rules.thin_from, *rules.material)
        states, matrices = zip(*[moved(p, k, z - p[f"z{k}"].to_numpy() + material) for k in "12"], strict=True)
        inverses = [inverted(m) for m in matrices]
        mean = inverted(inverses[0] + inverses[1])
        state = (mean @ (inverses[0] @ states[0][..., None] + inverses[1] @ states[1][..., None]))[..., 0]
        off = [s - state for s in states]
        chi2 = sum(np.einsum("ni,nij,nj->n", e, inverted(m - mean), e) for e, m in zip(off, matrices, strict=True))
        quality = -np.abs(s1 - s2) - chi2 * np.maximum(p["chi21"], 0.1) * np.maximum(p["chi22"], 0.1) / 3
        known = mean[:, 1, 1] * mean[:, 3, 3] - mean[:, 1, 3] ** 2
        near = doca * np.sqrt(np.minimum(p["energy1"] + p["energy2"], 5000.0) / 100) <= rules.most_doca
        reached = (np.abs(z - z1) <= rules.reach) & (np.abs(z - z2) <= rules.reach)
        good = near & reached & (chi2 >= 0) & (quality > rules.least_quality) & (known > 0) & (known < p["xss1"] * p["yss1"])
    out = pd.DataFrame({"event": p["event"], "first": p["track1"], "second": p["track2"], "quality": quality, "doca": doca, "z": z, "status": status.astype("int32")})
    return out[np.asarray(good, bool)]


def moved(p: pd.DataFrame, k: str, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States (x, slope, y, slope) and their covariances, `up` mm higher."""
    state, matrix = np.zeros((len(p), 4)), np.zeros((len(p), 4, 4))
    for i, v in ((0, "x"), (2, "y")):
        pp, ps, ss, s = (p[f"{v}{c}{k}"].to_numpy() for c in ("pp", "ps", "ss", "s"))
        state[:, i], state[:, i + 1] = p[f"{v}p{k}"].to_numpy() + s * up, s
        matrix[:, i, i], matrix[:, i + 1, i + 1] = pp + 2 * up * ps + up * up * ss, ss
        matrix[:, i, i + 1] = matrix[:, i + 1, i] = ps + up * ss
    return state, matrix


def inverted(m: np.ndarray) -> np.ndarray:
    """Inverses of matrices; NaN for singular ones, which fail all gates."""
    det = np.linalg.det(m)
    whole = np.where((np.isfinite(det) & (det != 0))[:, None, None], m, np.eye(4))
    return np.where((np.isfinite(det) & (det != 0))[:, None, None], np.linalg.inv(whole), np.nan)


def pairs(tracks: DataFrame, rules: Vertexing) -> DataFrame:
    """event, first, second, quality, doca, z, status: pairs of an event's tracks that may be a vertex, first before second."""
    a = tracks.select("event", *[F.col(c).alias(f"{c}1") for c in TRACK])
    b = tracks.select("event", *[F.col(c).alias(f"{c}2") for c in TRACK])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield judged(batch, rules)

    return a.join(b, "event").filter("track1 < track2").mapInPandas(run, PAIR)


def vertices(tracks: DataFrame, rules: Vertexing = Vertexing()) -> DataFrame:
    """tracks: event, track (their order, no ties), layer, cluster, width (of the first hit), energy, chi2 (of its first segment), z, and
    position, slope and covariances of both views there (xp, xs, xpp, xps, xss; yp ..). event, first, second, quality, doca, z, status.

    In the order of tracks each one that isn't used up takes the partner behind it with the best quality, if there is one, and both
    are used up; without one it is a vertex alone (second null, status 1). The quality falls with the difference of the arc lengths
    to the closest approach and with the chi-squared of the two states at the vertex; the approach must be close for the energy
    and the mean state's slopes better known than the first track's. Ties go to the earlier partner.

    Pairs are within an event, whose tracks the packing bounds; they are judged by batches of arrays, and the choice is one fold an event. Null clusters are never the
    same. Tracks with a singular covariance pair with none.
    """
    found = pairs(tracks, rules)
    best = F.collect_list(F.struct("first", (-F.col("quality")).alias("badness"), "second", "doca", "z", "status"))
    mates = found.groupBy("event").agg(best.alias("mates"))
    order = tracks.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("track", "z"))).alias("tracks"))
    rows = order.join(mates, "event", "left")
    kind = dict(tracks.dtypes)["track"]
    vertex = f"struct<first:{kind},second:{kind},quality:double,doca:double,z:double,status:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("used"), F.array().cast(f"array<{vertex}>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        mine = F.filter(F.coalesce("mates", F.array().cast(dict(mates.dtypes)["mates"])), lambda m: (m["first"] == t["track"]) & ~F.array_contains(acc["used"], m["second"]))
        chosen = F.array_min(mine)
        alone = F.struct(t["track"].alias("first"), F.lit(None).cast(kind).alias("second"), F.lit(None).cast("double").alias("quality"), F.lit(None).cast("double").alias("doca"), t["z"].alias("z"), F.lit(ONE).alias("status"))
        pair = F.struct(t["track"].alias("first"), chosen["second"].alias("second"), (-chosen["badness"]).alias("quality"), chosen["doca"].alias("doca"), chosen["z"].alias("z"), chosen["status"].alias("status"))
        new = F.when(chosen.isNull(), alone).otherwise(pair)
        used = F.when(chosen.isNull(), F.array(t["track"])).otherwise(F.array(t["track"], chosen["second"]))
        grown = F.struct(F.concat(acc["used"], used).alias("used"), F.concat(acc["found"], F.array(new)).alias("found"))
        return F.when(F.array_contains(acc["used"], t["track"]), acc).otherwise(grown)

    folded = rows.select("event", F.explode(F.aggregate("tracks", start, step)["found"]).alias("v"))
    return folded.select("event", "v.*")


def line_states(hits: DataFrame, resolution: float = 0.066) -> DataFrame:
    """hits: event, track, view, z, position. event, track, z (of the highest hit), and for both views position, slope, covariances there
    and chi2 (all views, over the degrees of freedom, at least 1): straight lines through the hits. Tracks without two heights in a view are left out."""
    top = hits.groupBy("event", "track").agg(F.max("z").alias("top"))
    rows = hits.join(top, ["event", "track"]).withColumn("h", F.col("z") - F.col("top"))
    sums = {f"{v}{n}": F.sum(F.when(F.col("view") == k, x)) for k, v in ((0, "x"), (1, "y")) for n, x in (("n", F.lit(1.0)), ("h", F.col("h")), ("hh", F.col("h") * F.col("h")), ("u", F.col("position")), ("uh", F.col("position") * F.col("h")))}
    s = rows.groupBy("event", "track", "top").agg(*[x.alias(c) for c, x in sums.items()])
    for v in "xy":
        n, h, hh, u, uh = (F.col(v + c) for c in ("n", "h", "hh", "u", "uh"))
        det = n * hh - h * h
        s = s.filter(det > 1e-9).withColumns({f"{v}p": (hh * u - h * uh) / det, f"{v}s": (n * uh - h * u) / det, f"{v}pp": resolution**2 * hh / det, f"{v}ps": -(resolution**2) * h / det, f"{v}ss": resolution**2 * n / det})
    lines = s.select("event", "track", *[f"{v}{c}" for v in "xy" for c in ("p", "s", "pp", "ps", "ss")])
    off = F.when(F.col("view") == 0, F.col("position") - F.col("xp") - F.col("xs") * F.col("h")).otherwise(F.col("position") - F.col("yp") - F.col("ys") * F.col("h")) / resolution
    chi2 = rows.join(lines.select("event", "track", "xp", "xs", "yp", "ys"), ["event", "track"]).groupBy("event", "track", F.col("top").alias("z")).agg((F.sum(off * off) / F.greatest(F.count("*") - 4, F.lit(1))).alias("chi2"))
    return lines.join(chi2, ["event", "track"])
