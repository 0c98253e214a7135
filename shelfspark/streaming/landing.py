"""Landing of extracts as they arrive: a file stream appended to the fact batches, a batch for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def land_files(spark: SparkSession, source: str, schema: StructType, root: str, checkpoint: str, doc_type: str) -> StreamingQuery:
    """Reads new Parquet files under `source` and appends them under `root`, partitioned by document type and batch.

    A micro-batch that runs again after a failure overwrites its own partition only, so every file lands once.
    """

    def append(rows: DataFrame, epoch: int) -> None:
        stamped = rows.withColumn("doc_type", F.lit(doc_type)).withColumn("batch_id", F.lit(f"stream-{epoch}"))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_type", "batch_id").parquet(root)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
