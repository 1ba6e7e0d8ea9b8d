"""Ordered folds: a scalar Kalman filter and smoother over sorted arrays, inside the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_filter(rows: DataFrame, by: str, order: list[str], measured: str, noise: float, error: float) -> DataFrame:
    """Of each group: n, the last filtered state and variance, and the summed chi-squared of the updates after the first."""
    steps = F.array_sort(F.collect_list(F.struct(*order, F.col(measured).cast("double").alias("m"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("p"), F.lit(0.0).alias("chi2"))

    def step(acc: Column, item: Column) -> Column:
        prior = acc["p"] + noise
        gain = prior / (prior + error)
        residual = item["m"] - acc["x"]
        first = acc["n"] == 0
        return F.struct(
            (acc["n"] + 1).alias("n"),
            F.when(first, item["m"]).otherwise(acc["x"] + gain * residual).alias("x"),
            F.when(first, F.lit(error)).otherwise((1 - gain) * prior).alias("p"),
            F.when(first, F.lit(0.0)).otherwise(acc["chi2"] + residual * residual / (prior + error)).alias("chi2"),
        )

    folded = rows.groupBy(by).agg(steps.alias("steps")).withColumn("f", F.aggregate("steps", start, step))
    return folded.select(by, F.col("f.n").alias("n"), F.col("f.x").alias("x"), F.col("f.p").alias("p"), F.col("f.chi2").alias("chi2"))
