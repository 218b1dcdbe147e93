"""Documents that arrive as files: every micro-batch is compared by the batch engine. Pairs are independent, so nothing is kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def compare_arrivals(spark: SparkSession, incoming: str, schema: str, out: str, checkpoint: str, compare: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Compares new Parquet files under `incoming` and writes each batch's result to its own folder, so a batch that runs again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        compare(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
