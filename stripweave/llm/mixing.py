"""Mixing sources to target weights by capped water-filling.

A source's share of the wanted total follows its weight; sources whose share is above `max_epochs`
times their size are clamped there, and the excess goes to the others by weight until none is
above. A source then gives whole repetitions of all its documents and, for the fraction, one more
of documents in a seeded order until the target is met, the last of them in part (`taken`; `repeats`
counts that one as whole if more than half of it is taken).

Null text: size 0, taken 0. Null source: a source of its own, ranked last. Ties of the seeded order
fall by doc_id; identical rows are taken alike or in either order. An empty table gives no rows. Only
doc_id, text and source are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, written

#: Contract values of op6.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 42
#: Hash ranges of a source, so that no window holds a whole source.
RANGES = 4096


def size_of() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""
    return docs.select("doc_id", "source", size_of())


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sources: source, source_size, weight. Adds target. One small aggregate for each round of clamping; a round without a new clamp ends it."""
    total = sources.agg(F.sum("source_size")).first()[0]
    wanted, level, clamped = float(total or 0) * share, 0.0, -1
    cap = F.col("source_size") * F.lit(max_epochs)
    while True:
        over = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(over, cap)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weights"), F.count(F.when(over, 1)).alias("n")).first()
        if row["n"] == clamped:
            break
        clamped = row["n"]
        if not row["weights"]:
            break
        level = max(0.0, wanted - (row["full"] or 0.0)) / row["weights"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """sizes: doc_id, source, size. Adds source_size, target, repeats (times the mix takes the document) and taken."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per_source = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    filled = water_fill(ranked.withColumn("weight", F.element_at(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)), share, max_epochs)
    plan = filled.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("epochs"))
    plan = plan.withColumn("whole", F.floor(F.col("epochs") + 1e-12)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sizes.withColumn("key", key).withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % RANGES)
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("before"))
    before = before.join(plan.withColumnRenamed("source", "p"), F.col("s").eqNullSafe(F.col("p"))).drop("p")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = rows.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    part = F.when(F.col("whole") < F.lit(max_epochs), F.greatest(F.lit(0), F.least(F.col("size"), F.round(F.col("rest")).cast("long") - F.col("before") - F.col("inside")))).otherwise(0)
    repeats = (F.col("whole") + F.when(2 * part > F.col("size"), 1).otherwise(0)).cast("long")
    taken = (F.col("whole") * F.col("size") + part).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), taken.alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it, all columns as they were. Rows of one doc_id, source and size are repeated alike."""
    sizes = written(sized(docs), "sizes")
    times = mix(sizes).groupBy(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size")).agg(F.max("repeats").alias("m_repeats"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select("doc_id", "source", size_of(), whole)
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size"))
    rows = rows.join(times.filter("m_repeats > 0"), same)
    return rows.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m_repeats")))).select("whole.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(written(sized(documents(spark, sf_dir)), "sizes")).select("doc_id", "size", "source_size", "target", "taken")
