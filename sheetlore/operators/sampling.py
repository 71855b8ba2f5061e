"""Repeatable random samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlore.operators.numbering import hash_order, number_by_hash


def random_sample(df: DataFrame, n: int = 500, key: str = "id", seed: str = "sample") -> DataFrame:
    """``n`` rows in hash order; each task keeps at most ``n`` candidates."""
    return df.withColumn("_hash", hash_order(F.col(key), seed)).orderBy("_hash", key).limit(n).drop("_hash")


def exact_split(df: DataFrame, key: str = "id", seed: str = "split") -> DataFrame:
    """Column ``set``: first 80 %, next 10 % and last 10 % of the rows in hash order."""
    total = df.agg(F.count("*").alias("n")).scalar()
    numbered = number_by_hash(df, key, seed).withColumn("_total", total)
    position = F.col("row_no") - 1
    label = (
        F.when(position < F.floor(F.col("_total") * 0.8), "TRAIN")
        .when(position < F.floor(F.col("_total") * 0.9), "VALIDATE")
        .otherwise("TEST")
    )
    return numbered.withColumn("set", label).drop("row_no", "_total")


def hashed_split(df: DataFrame, key: str = "id", seed: str = "split") -> DataFrame:
    """Same shares in expectation, decided row by row without any shuffle."""
    share = F.conv(F.substring(hash_order(F.col(key), seed), 1, 7), 16, 10).cast("bigint") / F.lit(float(16**7))
    return df.withColumn("set", F.when(share < 0.8, "TRAIN").when(share < 0.9, "VALIDATE").otherwise("TEST"))
