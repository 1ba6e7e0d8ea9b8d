"""Two-pass external shuffle into shards.

Pass one scatters rows over memory-sized buckets by seeded hashes; pass two puts each bucket in an order by
Fisher-Yates, whose draws are hashes of the seed, shard, bucket and step, and writes it. So the order depends on
the rows and the seed alone, not on partitions or retries. The law is `key`: doc_id and the number of shards decide
(the highest of one hash for each shard), so one more shard only takes rows into itself.

Null text: no bytes, size 1, crc32 of the empty text, stored as null. Null doc_id: hashed as the text "null".
Rows of one doc_id share a shard; its buckets are told apart by text as well. Repeated rows are counted and dealt
over the buckets by their number, so no bucket holds all of them; they take different slots. Very long texts: a row is never
split, so its bucket is larger. An empty table gives no rows. Only doc_id and text are used, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, written
from .jaccard import small

SHARDS, SEED, BUCKET_BYTES, BUCKET_ROWS = 16, 42, 4 << 20, 2048


def key_shard(shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with doc_id is highest; ties go to the lower shard."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    best = F.greatest(*[F.struct(F.xxhash64(name, F.lit(seed), F.lit(k)).alias("h"), F.lit(-k).alias("k")) for k in range(shards)])
    return -best["k"]


def fisher_yates(n: Column, *seed: Column) -> Column:
    """A permutation of 0 to n - 1, n at least 1: each number takes a drawn place, whose holder moves to the end."""

    def step(order: Column, i: Column) -> Column:
        at = F.pmod(F.xxhash64(*seed, i), i + 1).cast("int")
        moved = F.concat(F.slice(order, 1, at), F.array(i), F.slice(order, at + 2, F.greatest(i - at - 1, F.lit(0))), F.array(F.get(order, at)))
        return F.when(at == i, F.concat(order, F.array(i))).otherwise(moved)

    rest = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, F.array(F.lit(0)), step)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text, copy: equal rows are numbered from 0. Only repeated rows meet, as counts."""
    rows = docs.select("doc_id", "text")
    again = rows.groupBy("doc_id", F.xxhash64("text").alias("same")).agg(F.count("*").alias("n")).filter("n > 1")
    again = written(again.select(F.col("doc_id").alias("again_id"), F.col("same").alias("again_same")), "repeated")
    n = again.count()
    if not n:
        return rows.withColumn("copy", F.lit(0))
    repeated = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.xxhash64("text") == F.col("again_same"))
    alone = rows.join(small(again, n), repeated, "left_anti").withColumn("copy", F.lit(0))
    counted = rows.join(small(again, n), repeated, "left_semi").groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("n"))
    return alone.unionByName(counted.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> None:
    """Writes doc_id, text, shard, grown_shard, bucket, place (from 0 in the bucket), one folder for each shard."""
    total, n = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)), F.lit(0)), F.count("*")).first()
    buckets = max(1, math.ceil(total / shards / bucket_bytes), math.ceil(n / shards / bucket_rows))
    rows = numbered(docs).select("doc_id", "text", "copy", key_shard(shards, seed).alias("shard"), key_shard(shards + 1, seed).alias("grown_shard"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text", "copy", F.lit(seed + 1)), F.lit(buckets)).cast("int"))
    held = F.array_sort(F.collect_list(F.struct("doc_id", "copy", "text", "grown_shard")))
    filled = rows.groupBy("shard", "bucket").agg(held.alias("held"))
    order = fisher_yates(F.size("held"), F.lit(seed), F.col("shard"), F.col("bucket"))
    placed = filled.select("shard", "bucket", F.posexplode(F.transform(order, lambda i: F.get("held", i))).alias("place", "row"))
    placed.select("row.doc_id", "row.text", "shard", "row.grown_shard", "bucket", "place").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows as written, with slot: gapless from 0 in each shard, bucket after bucket."""
    rows = spark.read.schema("doc_id long, text string, grown_shard int, bucket int, place int, shard int").parquet(path)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return rows.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))}).drop("text").join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("place"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    write_shards(documents(spark, sf_dir), path)
    return read_shards(spark, path).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
