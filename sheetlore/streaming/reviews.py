"""Review files as a stream: the corrections log grows, and each training row comes out once.

The log is appended to by a file sink. Training rows pass an operator that remembers, per row, that it
was seen, so a correction that comes again in a later file adds nothing. A micro-batch that is replayed
writes the files it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetlore.operators import review as rev

ROW = ["id", "original_text", "new_name", "new_type"]


def review_stream(spark: SparkSession, source: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(source)


def append_log(reviews: DataFrame, log_path: str, checkpoint: str, logged_at: str) -> None:
    """Append the log entries of all review files that have come since the last run."""
    entries = rev.log_entries(reviews, logged_at)
    entries.writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_training_rows(reviews: DataFrame, rows_path: str, checkpoint: str, logged_at: str) -> None:
    """Append the training rows that no earlier file brought."""
    rows = rev.training_rows_from_log(rev.log_entries(reviews, logged_at)).dropDuplicates(ROW)
    rows.writeStream.format("parquet").option("path", rows_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
