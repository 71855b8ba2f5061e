"""Row numbers over large groups without sorting a whole group in one task.

A group is cut into buckets by an expression that follows the sort order. Rows are numbered
inside their bucket and shifted by the number of rows in the buckets before it, so the
largest sort is one bucket and only the bucket counts are summed per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], name: str = "row_no"
) -> DataFrame:
    """Add ``name`` = 1, 2, … per ``keys``; ``bucket`` must not decrease along ``order``.

    Choose a bucket with a bounded number of values per group, such as a pixel row or a hash
    prefix: the counts of one group are summed in one task.
    """
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = marked.withColumn("_inside", F.row_number().over(inside))
    joined = numbered.alias("r").join(
        offsets.alias("o"),
        on=[F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*keys, "_bucket")],
    )
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._inside") + F.col("o._offset")).alias(name))


def hash_order(key: Column, seed: str) -> Column:
    """Repeatable pseudo-random sort key of a row."""
    return F.md5(F.concat_ws("#", F.lit(seed), key.cast("string")))


def number_by_hash(df: DataFrame, key: str, seed: str, name: str = "row_no") -> DataFrame:
    """Number all rows in pseudo-random order; 65,536 buckets share the work."""
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed))
    numbered = number_rows(hashed, [], F.substring("_hash", 1, 4), ["_hash", key], name)
    return numbered.drop("_hash")
