"""The first pass over a stream of event files: all rows of an event come in one file, so batches are independent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..jobs.reconstruct import Config, first_pass


def start(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, config: Config = Config(), files_per_batch: int = 8) -> StreamingQuery:
    """Reads Parquet files as they come and writes summaries and refused events under out, a folder for each batch.

    A batch that is run again overwrites its own folder, so results stay exact after a restart.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = first_pass(batch, config)
        found.summary.write.mode("overwrite").parquet(f"{out}/summary/batch={number}")
        found.errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
