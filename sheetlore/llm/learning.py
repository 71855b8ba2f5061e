"""Labelled rows for the classifiers: bounded, reproducible samples of whole texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows a classifier is fitted on.
TRAINING_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: Column) -> DataFrame:
    """doc_id, label, text of at most ``rows`` labelled documents: those whose hashed id comes first.

    Only rows for which ``learn`` holds (an expression of doc_id) are taken; null labels and ids are not.
    The sample of ids is bounded, so it may be broadcast; it does not depend on how the tables are laid out.
    """
    chosen = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .dropDuplicates(["doc_id"])
        .withColumn("draw", F.xxhash64(F.lit("sample"), "doc_id"))
        .orderBy("draw", "doc_id").limit(rows).drop("draw")
    )
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
