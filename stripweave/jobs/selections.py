"""Queries on filters, flags, guards and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.hits import SQL_ORDERS, order_hits, table
from .register import query

L = f"WITH {SQL_ORDERS}"


@query("f1_plane_hits", f"{L} SELECT event, strip, width, price FROM l WHERE view = 0 AND layer = 2 AND width <> 8")
def plane_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_hits(spark, sf_dir).filter("view = 0 AND layer = 2 AND width <> 8").select("event", "strip", "width", "price")


@query("f2_status_bits", f"{L} SELECT event, bit_or((CASE WHEN width > 4 THEN 1 ELSE 0 END) | (CASE WHEN strip < 100 THEN 4 ELSE 0 END) | (CASE WHEN tower = 1 THEN 16 ELSE 0 END))::INT AS status, count(*) FILTER (width > 4 AND strip >= 100) AS n_used_only FROM l GROUP BY event")
def status_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda cond, b: F.when(cond, F.lit(b)).otherwise(F.lit(0))
    s = bit(F.col("width") > 4, 1).bitwiseOR(bit(F.col("strip") < 100, 4)).bitwiseOR(bit(F.col("tower") == 1, 16))
    rows = order_hits(spark, sf_dir).withColumn("status", s)
    used_only = (F.col("status").bitwiseAND(F.lit(1)) != 0) & (F.col("status").bitwiseAND(F.lit(4)) == 0)
    return rows.groupBy("event").agg(F.expr("bit_or(status)").alias("status"), F.count(F.when(used_only, 1)).alias("n_used_only"))


@query("f3_event_guard", f"{L}, big AS (SELECT event FROM l GROUP BY event HAVING count(*) > 6) SELECT event, count(*) AS n_clusters FROM l WHERE event NOT IN (SELECT event FROM big) GROUP BY event")
def event_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with too many clusters are left out (F3; F4 is the same with points)."""
    return order_hits(spark, sf_dir).groupBy("event").agg(F.count("*").alias("n_clusters")).filter("n_clusters <= 6")


@query("f5_field_of_view", "SELECT vec_id AS id, label FROM embeddings WHERE abs(embedding[3]::DOUBLE) >= 0.19 * sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2)")
def field_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (F.get("embedding", F.lit(i)).cast("double") for i in range(3))
    return table(spark, sf_dir, "embeddings").filter(F.abs(z) >= 0.19 * F.sqrt(x**2 + y**2 + z**2)).select(F.col("vec_id").alias("id"), "label")


@query("f6_wide_clusters", f"{L} SELECT event, count(*) AS n_kept, max(width) AS widest FROM l WHERE width <= 3 + 3 * abs((strip - 768) / 768.0) GROUP BY event")
def wide_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = order_hits(spark, sf_dir).filter(F.col("width") <= 3 + 3 * F.abs((F.col("strip") - 768) / 768.0))
    return kept.groupBy("event").agg(F.count("*").alias("n_kept"), F.max("width").alias("widest"))


@query("f7_edge_seeds", f"{L} SELECT event, layer, strip, price FROM l WHERE layer >= 4 OR abs(strip - 768) >= 540")
def edge_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_hits(spark, sf_dir).filter((F.col("layer") >= 4) | (F.abs(F.col("strip") - 768) >= 540)).select("event", "layer", "strip", "price")


@query("f8_three_of_four", "SELECT l_orderkey AS event, l_linenumber AS layer, count(*) AS n FROM lineitem WHERE (l_quantity < 40)::INT + (l_discount < 0.08)::INT + (l_tax < 0.06)::INT + (l_extendedprice < 70000)::INT >= 3 GROUP BY ALL")
def three_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    passed = sum(((F.col(c) < v).cast("int") for c, v in (("l_discount", 0.08), ("l_tax", 0.06), ("l_extendedprice", 70000))), (F.col("l_quantity") < 40).cast("int"))
    return rows.filter(passed >= 3).groupBy(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("layer")).agg(F.count("*").alias("n"))


@query("s7_stage_summary", "SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS rms FROM events GROUP BY event_type")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("rms"))


@query("o5_best_candidates", f"{L} SELECT event, price, rank FROM (SELECT event, price, row_number() OVER (PARTITION BY event ORDER BY width DESC, strip, part, supp, price) AS rank FROM l) WHERE rank <= 3")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded best-first lists by rank: the rank that O2 to O5 and T9 share, without their further rules."""
    w = Window.partitionBy("event").orderBy(F.desc("width"), "strip", "part", "supp", "price")
    return order_hits(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("event", "price", "rank")


@query("n2_share_energy", "SELECT o_orderkey AS track, o_custkey AS event, CASE WHEN n = 1 THEN round(total * 0.5, 4) WHEN r <= 2 THEN round(total * 0.25, 4) ELSE 30.0 END AS energy FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)")
def share_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    r = F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.count("*").over(by).alias("n"), F.max("o_totalprice").over(by).alias("total"), r.alias("r"))
    e = F.when(F.col("n") == 1, F.round(F.col("total") * 0.5, 4)).when(F.col("r") <= 2, F.round(F.col("total") * 0.25, 4)).otherwise(30.0)
    return rows.select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("event"), e.alias("energy"))


@query("n5_first_track_weight", "SELECT o_orderkey AS track, CASE WHEN n = 1 THEN 1.0 WHEN r = 1 THEN 0.8 ELSE round(0.2 / (n - 1), 6) END::DOUBLE AS weight FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)")
def first_track_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(by).alias("n"), F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("r"))
    return rows.select(F.col("o_orderkey").alias("track"), F.when(F.col("n") == 1, 1.0).when(F.col("r") == 1, 0.8).otherwise(F.round(0.2 / (F.col("n") - 1), 6)).alias("weight"))
