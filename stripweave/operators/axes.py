"""Principal axes and moments that drop their outliers, for all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import moments
from .graph import cut_lineage


def with_axis(rows: DataFrame) -> DataFrame:
    """rows of moments.principal; adds ax, ay, az: the unit direction of the largest moment, upwards.

    It is at right angles to the rows of (covariance - e1), so the longest cross product of two of them; vertical if all are alike.
    """
    c = {k: F.col(f"c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    m = [(c["xx"] - F.col("e1"), c["xy"], c["xz"]), (c["xy"], c["yy"] - F.col("e1"), c["yz"]), (c["xz"], c["yz"], c["zz"] - F.col("e1"))]
    found = []
    for a, b in ((0, 1), (0, 2), (1, 2)):
        u, v = m[a], m[b]
        x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        found.append(F.struct((x * x + y * y + z * z).alias("s"), x.alias("x"), y.alias("y"), z.alias("z")))
    rows = rows.withColumn("axis", F.greatest(*found))
    size = F.sqrt("axis.s") * F.when(F.col("axis.z") < 0, -1).otherwise(1)
    flat = F.col("axis.s") < 1e-30
    return rows.withColumns({f"a{k}": F.when(flat, 1.0 if k == "z" else 0.0).otherwise(F.col(f"axis.{k}") / size) for k in "xyz"}).drop("axis")


def trimmed_moments(points: DataFrame, factor: float = 2.0, least: int = 10, most_rounds: int = 100) -> DataFrame:
    """points: grp, id, x, y, z. grp, n, n_dropped, n_rounds, centroid, axis and moments of each group without its outliers.

    Each round sorts by the distance from the axis and compares with that at 68 %: the last point goes if it is further than the
    last limit times that (first 1), and then all that are further than the present limit, which doubles each round. A
    group ends when nothing is dropped, when it has fewer than `least` points, or fewer than 3 are left. Rounds run for
    all groups at once and are written; each group that goes on loses a point in each, and the limit doubles. Ties in distance fall by id.
    """
    now = points.select("grp", "id", "x", "y", "z").withColumns({"was": F.lit(1.0), "open": F.lit(True), "n_rounds": F.lit(0), "n_dropped": F.lit(0).cast("long")})
    limit = factor
    for _ in range(most_rounds):
        fit = with_axis(moments.principal(moments.scatter(now, "grp"))).select("grp", F.col("n").alias("size"), *[f"m{k}" for k in "xyz"], *[f"a{k}" for k in "xyz"])
        p = now.join(fit, "grp")
        d = [F.col(k) - F.col(f"m{k}") for k in "xyz"]
        along = d[0] * F.col("ax") + d[1] * F.col("ay") + d[2] * F.col("az")
        p = p.withColumn("d", F.round(F.sqrt(F.greatest(F.lit(0.0), d[0] * d[0] + d[1] * d[1] + d[2] * d[2] - along * along)), 12))
        order = Window.partitionBy("grp").orderBy("d", "id")
        whole = Window.partitionBy("grp")
        p = p.withColumn("rank", F.row_number().over(order)).withColumn("d68", F.max(F.when(F.col("rank") == F.floor(0.68 * F.col("size")) + 1, F.col("d"))).over(whole))
        works = F.col("open") & (F.col("size") >= least)
        last = (F.col("rank") == F.col("size")) & (F.col("d") > F.col("was") * F.col("d68"))
        drops = F.max(F.when(works & last, 1).otherwise(0)).over(whole) == 1
        p = p.withColumn("drops", drops).withColumn("gone", F.col("drops") & (last | (F.col("d") > limit * F.col("d68"))))
        p = p.withColumn("left", F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(whole))
        state = {
            "n_rounds": F.col("n_rounds") + F.when(works, 1).otherwise(0),
            "n_dropped": F.col("n_dropped") + F.col("size") - F.col("left"),
            "was": F.when(F.col("drops"), limit).otherwise(F.col("was")),
            "open": F.col("drops") & (F.col("left") >= 3),
        }
        now = cut_lineage(p.withColumns(state).filter("NOT gone").select(*now.columns))
        limit *= 2
        if not now.filter("open").limit(1).count():
            break
    else:
        raise RuntimeError(f"a group is still losing points after {most_rounds} rounds")
    told = now.groupBy("grp").agg(F.first("n_dropped").alias("n_dropped"), F.first("n_rounds").alias("n_rounds"))
    return with_axis(moments.principal(moments.scatter(now, "grp"))).join(told, "grp")


def reweighted_moments(points: DataFrame, factor: float = 1.0, flat: float = 0.25, most_rounds: int = 1000) -> DataFrame:
    """points: grp, id, x, y, z. grp, n, n_dropped, n_rounds, chi2, centroid (mx, my, mz), axis (ax, ay, az) and covariances (cxx ..) of each
    group, its points weighted by their nearness to the axis.

    A round takes the moments about the last centroid (first: the mean) with the last weights (first: 1), and drops the points further from
    the axis than the limit times its transverse size: the root of the root of the transverse moment over the sum of weights, over that sum.
    If the first axis is flatter than `flat` it is put upright, and the size made such that only the furthest point, if it is alone by a
    millimetre, is beyond the limit. A round that drops points weights the others by the inverse of their distance and doubles the limit; one
    that drops none is a group's last. A group of fewer than two points, or of points without extent, ends with what it had.

    Rounds run for all open groups at once and are written; each open group loses a point a round, so they end. Null coordinates: the
    row is left out. A group that never had moments has a null axis.
    """
    xyz = ("x", "y", "z")
    has = points.filter(" AND ".join(f"{c} IS NOT NULL" for c in xyz)).select("grp", "id", *xyz).withColumn("weight", F.lit(1.0))
    start = has.groupBy("grp").agg(*[F.avg(c).alias(f"m{c}") for c in xyz], F.count("*").alias("n"))
    told = ["n_dropped", "n_rounds", "chi2", *[f"a{c}" for c in xyz], *[f"c{a}{b}" for i, a in enumerate(xyz) for b in xyz[i:]]]
    blank = {"n_dropped": F.lit(0).cast("long"), "n_rounds": F.lit(0)} | {c: F.lit(None).cast("double") for c in told[2:]}
    state = cut_lineage(start.withColumns(blank))
    done, now, limit = [], cut_lineage(has), factor
    for number in range(most_rounds):
        at = now.join(state.select("grp", *[F.col(f"m{c}").alias(f"o{c}") for c in xyz]), "grp")
        off = {c: F.col(c) - F.col(f"o{c}") for c in xyz}
        w = F.col("weight")
        second = [(F.sum(w * off[a] * off[b]) / F.sum(w)).alias(f"c{a}{b}") for i, a in enumerate(xyz) for b in xyz[i:]]
        fit = at.groupBy("grp").agg(F.count("*").alias("n"), F.sum(w).alias("w"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}") for c in xyz], *second)
        fit = with_axis(moments.principal(fit)).filter("n > 1 AND e1 > 1e-24")
        upright = F.abs("az") < flat if number == 0 else F.lit(False)
        fit = cut_lineage(fit.withColumn("size", F.sqrt(F.sqrt(F.greatest(F.lit(0.0), F.col("e2") + F.col("e3"))) / F.col("w"))).withColumn("upright", upright))
        p = at.join(fit.select("grp", "size", "upright", F.col("w").alias("total"), F.col("n").alias("of"), *[f"a{c}" for c in xyz], *[F.col(f"m{c}") for c in xyz]), "grp")

        def distance(center: str, axis: list[Column]) -> Column:
            d = [F.col(c) - F.col(f"{center}{c}") for c in xyz]  # noqa: B023
            cross = [d[1] * axis[2] - d[2] * axis[1], d[2] * axis[0] - d[0] * axis[2], d[0] * axis[1] - d[1] * axis[0]]
            return F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])

        first = distance("o", [F.col(f"a{c}") for c in xyz])
        p = p.withColumn("d", F.when(F.col("upright"), distance("m", [F.lit(0.0), F.lit(0.0), F.lit(1.0)])).otherwise(first)).withColumn("part", w * first * first)
        furthest = p.groupBy("grp").agg(F.max("d").alias("far"), (F.sum("part") / F.max("total") / F.max("of")).alias("chi2"))
        p = cut_lineage(p.join(furthest, "grp").withColumn("gone", F.col("d") > limit * F.when(F.col("upright"), (F.col("far") - 1) / limit).otherwise(F.col("size"))))
        lost = p.groupBy("grp").agg(F.count(F.when(F.col("gone"), 1)).alias("lost"), F.first("chi2").alias("chi2"))
        up = {f"a{c}": F.when(F.col("upright"), 1.0 if c == "z" else 0.0).otherwise(F.col(f"a{c}")).alias(f"a{c}") for c in xyz}
        told_now = fit.join(lost, "grp").select("grp", *[f"m{c}" for c in xyz], *up.values(), *[c for c in told if c[0] == "c" and c != "chi2"], "chi2", "lost", (F.col("n") - F.col("lost")).alias("left"))
        before = state.select("grp", F.col("n_dropped").alias("dropped_before"), F.col("n_rounds").alias("rounds_before"))
        after = told_now.join(before, "grp").withColumns({"n": F.col("left"), "n_dropped": F.col("dropped_before") + F.col("lost"), "n_rounds": F.col("rounds_before") + 1})
        after = cut_lineage(after.select("lost", *state.columns))
        done.append(state.join(after.select("grp"), "grp", "left_anti").unionByName(after.filter("lost = 0").drop("lost")))
        state = after.filter("lost > 0").drop("lost")
        limit *= 2
        if not state.limit(1).count():
            break
        now = cut_lineage(p.filter("NOT gone").join(state.select("grp"), "grp").withColumn("weight", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1000.0)).select(*has.columns))
    else:
        raise RuntimeError(f"a group is still losing points after {most_rounds} rounds")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
