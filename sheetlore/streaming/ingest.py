"""Incremental ingestion: new files of detections, map by map, into a growing table.

A run takes in what arrived since the last one. Maps that were in the table when the run began are
skipped; how the run's files are cut into micro-batches makes no difference.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAPS, _ENDED = "map_name string, run bigint", "run bigint"


def _run_number(spark: SparkSession, maps_path: str) -> int:
    """Number of the run that is to be done: a run that broke off is done again under its number."""
    ended = f"{maps_path}/ended"
    spark.createDataFrame([], _ENDED).write.mode("append").parquet(ended)
    last = spark.read.schema(_ENDED).parquet(ended).agg(F.max("run")).first()[0]
    return (last or 0) + 1


def _end_run(spark: SparkSession, maps_path: str, run: int) -> None:
    spark.createDataFrame([(run,)], _ENDED).coalesce(1).write.mode("append").parquet(f"{maps_path}/ended")


def merge_batch(rows: DataFrame, run: int, part: str, table_path: str, maps_path: str) -> None:
    """Append the rows of maps that no earlier run brought.

    A list of maps, one row each, stands beside the table, so that the check does not read
    the table itself. Table and list are written in one folder per ``part``, and a batch that
    is replayed after a failure overwrites its own folder, so nothing is written twice.
    """
    spark, listed = rows.sparkSession, f"{maps_path}/maps"
    spark.createDataFrame([], _MAPS).write.mode("append").parquet(f"{listed}/part=none")
    known = spark.read.schema(_MAPS).parquet(listed).filter(F.col("run") < run).select("map_name")
    fresh = rows.join(known, "map_name", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{table_path}/part={part}")
    written = spark.read.parquet(f"{table_path}/part={part}")
    written.select("map_name", F.lit(run).cast("bigint").alias("run")).distinct().write.mode("overwrite").parquet(f"{listed}/part={part}")


def seed(rows: DataFrame, table_path: str, maps_path: str) -> None:
    """First content of the table, before any stream ran."""
    merge_batch(rows, 0, "seed", table_path, maps_path)


def ingest_files(
    spark: SparkSession, source_path: str, schema, table_path: str, maps_path: str, checkpoint_path: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int | None = None, name_filter: str | None = None,
) -> None:
    """Take in all files that arrived since the last run, then stop.

    The stream's checkpoint remembers the files; ``merge_batch`` skips maps of earlier runs.
    Folders carry the number of the run and the identity of the checkpoint, so neither a later run
    nor a new checkpoint writes over what is there. ``files_per_batch`` only bounds a batch.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = transform(reader.load(source_path))
    run = _run_number(spark, maps_path)

    def take_in(df: DataFrame, batch: int) -> None:
        identity = json.loads(df.sparkSession.read.text(f"{checkpoint_path}/metadata").first()[0])["id"]
        merge_batch(df, run, f"{run}-{identity}-{batch}", table_path, maps_path)

    query = stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
    query.awaitTermination()
    _end_run(spark, maps_path, run)


def read_table(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.parquet(table_path)
