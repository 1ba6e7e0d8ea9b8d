"""Tables that keep an event's rows together: bucketed and sorted by event, partitioned by run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: A join by event and more keys needs no exchange where both sides are dealt by event alone.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{base.rstrip('/')}/stripweave"


def save(rows: DataFrame, name: str, buckets: int, order: tuple[str, ...] = (), run: str | None = None, path: str | None = None) -> DataFrame:
    """rows as the table `name`: `buckets` files by a hash of event, each sorted by event and order, for each value of column
    run if it is given. A new table is made; of a table that exists, only the runs that rows hold are replaced (without run, all of
    it), so a batch that is run again leaves one copy. Without a path the files lie in the shared folder.

    The exchange by event happens here, once; what reads the table by event needs none. An event of null is a bucket's as any other.
    Empty rows leave the table as it is, or make an empty one.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(buckets, "event")
    if spark.catalog.tableExists(name):
        with setting(spark, DYNAMIC, "dynamic" if run else "static"):
            dealt.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    else:
        writer = dealt.write.format("parquet").bucketBy(buckets, "event").sortBy("event", *order).option("path", path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
        (writer.partitionBy(run) if run else writer).saveAsTable(name)
    return spark.table(name)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def joined_in_place(spark: SparkSession) -> None:
    """From now on this session joins tables that are bucketed by event in place, also by event and layer."""
    spark.conf.set(CO_PARTITION, "false")
