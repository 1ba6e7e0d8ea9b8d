"""Hits and points as views of the given tables, in whole numbers so that keys are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRIPS, LAYERS = 1536, 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, layer, tower, view, strip, width, part, supp, price: an order is an event, its line numbers are layers."""
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event"),
        F.col("l_linenumber").cast("int").alias("layer"),
        (F.col("l_suppkey") % 2).cast("int").alias("tower"),
        (F.col("l_partkey") % 2).cast("int").alias("view"),
        (price % STRIPS).alias("strip"),
        (F.col("l_quantity").cast("int") % 8 + 1).alias("width"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        price.alias("price"),
    )


def user_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, layer, view, strip, hit: a user is an event, the event id gives layer and view."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("event"),
        (F.col("event_id") % LAYERS).cast("int").alias("layer"),
        (F.floor(F.col("event_id") / LAYERS) % 2).cast("int").alias("view"),
        (F.round(F.col("value") * 100).cast("long") % STRIPS).alias("strip"),
        F.col("event_id").alias("hit"),
    )


def label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, id, x, y, z: the first three dimensions of a vector are a point, its label the group."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


#: The same views for DuckDB.
SQL_ORDERS = """
l AS (SELECT l_orderkey AS event, l_linenumber::INT AS layer, (l_suppkey % 2)::INT AS tower, (l_partkey % 2)::INT AS view,
  round(l_extendedprice * 100)::BIGINT % 1536 AS strip, (trunc(l_quantity)::INT % 8) + 1 AS width,
  l_partkey AS part, l_suppkey AS supp, round(l_extendedprice * 100)::BIGINT AS price FROM lineitem)"""
SQL_USERS = """
e AS (SELECT user_id AS event, (event_id % 18)::INT AS layer, ((event_id // 18) % 2)::INT AS view,
  round(value * 100)::BIGINT % 1536 AS strip, event_id AS hit FROM events)"""
SQL_POINTS = """
v AS (SELECT label AS grp, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""
