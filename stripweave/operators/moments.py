"""Moments, principal axes, accumulators, boxes, line fits: aggregates with partial sums only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scatter(points: DataFrame, by: str, weight: Column | None = None) -> DataFrame:
    """Weighted centroid and the six central second moments of each group."""
    w = F.lit(1.0) if weight is None else weight
    axes = ("x", "y", "z")
    sums = points.groupBy(by).agg(F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(w * F.col(a)).alias(f"s{a}") for a in axes], *[F.sum(w * F.col(a) * F.col(b)).alias(f"s{a}{b}") for i, a in enumerate(axes) for b in axes[i:]])
    mean = {a: F.col(f"s{a}") / F.col("w") for a in axes}
    return sums.select(by, "n", "w", *[mean[a].alias(f"m{a}") for a in axes], *[(F.col(f"s{a}{b}") / F.col("w") - mean[a] * mean[b]).alias(f"c{a}{b}") for i, a in enumerate(axes) for b in axes[i:]])


def principal(rows: DataFrame) -> DataFrame:
    """Adds the eigenvalues e1 >= e2 >= e3 of the covariances, by the closed form for symmetric 3 x 3 matrices."""
    c = {k: F.col(f"c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    off = c["xy"] ** 2 + c["xz"] ** 2 + c["yz"] ** 2
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    p = F.sqrt(((c["xx"] - q) ** 2 + (c["yy"] - q) ** 2 + (c["zz"] - q) ** 2 + 2 * off) / 6)
    rows = rows.withColumn("q", q).withColumn("p", p)
    b = {k: ((c[k] - F.col("q")) if k in ("xx", "yy", "zz") else c[k]) / F.col("p") for k in c}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] ** 2) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    rows = rows.withColumn("phi", F.when(F.col("p") > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3).otherwise(0.0))
    e1 = F.col("q") + 2 * F.col("p") * F.cos("phi")
    e3 = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * math.pi / 3)
    return rows.withColumn("e1", e1).withColumn("e3", e3).withColumn("e2", 3 * F.col("q") - F.col("e1") - F.col("e3")).drop("q", "p", "phi")


def line_fit(rows: DataFrame, by: str, z: Column, y: Column, w: Column) -> DataFrame:
    """Weighted straight line y = slope * z + intercept with chi-squared and covariances."""
    s = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(w).alias("s"), F.sum(w * z).alias("sz"), F.sum(w * y).alias("sy"), F.sum(w * z * z).alias("szz"), F.sum(w * z * y).alias("szy"), F.sum(w * y * y).alias("syy"))
    s = s.withColumn("det", F.col("s") * F.col("szz") - F.col("sz") ** 2).filter("det > 0")
    slope = (F.col("s") * F.col("szy") - F.col("sz") * F.col("sy")) / F.col("det")
    intercept = (F.col("szz") * F.col("sy") - F.col("sz") * F.col("szy")) / F.col("det")
    s = s.withColumn("slope", slope).withColumn("intercept", intercept)
    chi2 = F.col("syy") - F.col("slope") * F.col("szy") - F.col("intercept") * F.col("sy")
    return s.select(by, "n", "slope", "intercept", (F.col("s") / F.col("det")).alias("var_slope"), (F.col("szz") / F.col("det")).alias("var_intercept"), chi2.alias("chi2"))


def bins(points: DataFrame, size: float) -> DataFrame:
    """Adds the accumulator bin of each point: floor((p + size / 2) / size) on each axis."""
    return points.withColumns({f"b{a}": F.floor((F.col(a) + size / 2) / size).cast("int") for a in ("x", "y", "z")})


def leave_one_out(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """rows: by, z, y. Adds residual: of each row from the straight line through all others of its group; groups under `least` rows are left out."""
    z, y = F.col("z"), F.col("y")
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(z).alias("mz"), F.avg(y).alias("my"), (F.sum(z * z) - F.sum(z) * F.sum(z) / F.count("*")).alias("szz"), (F.sum(z * y) - F.sum(z) * F.sum(y) / F.count("*")).alias("szy"))
    off = y - F.col("my") - F.col("szy") / F.col("szz") * (z - F.col("mz"))
    own = 1 - F.lit(1.0) / F.col("n") - (z - F.col("mz")) * (z - F.col("mz")) / F.col("szz")
    return rows.join(s.filter(F.col("n") >= least), by).withColumn("residual", off / own).drop("n", "mz", "my", "szz", "szy")
