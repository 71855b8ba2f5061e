"""Token counts from the exact histogram of encoded lengths.

Documents are counted by their number of tokens. Sums over the histogram from either end then
answer, for every context limit, how many documents fit, how many tokens there are, what is left
when each document is cut at the limit, and at which quantile the limit lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlore.llm.bpe_automaton import shared_tables
from sheetlore.llm.common import parts, stored

#: Lengths summed together before the sums over all lengths.
STRETCH = 1024


def length_histogram(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length; null and empty texts have 0 tokens.

    Only counts are shuffled, summed in each task first. An empty table gives no rows.
    """
    shared = shared_tables(docs.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.encoder()
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(encoder.counts(batch.column(0).to_pylist()), pa.int64())], ["n_tokens"])

    lengths = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "n_tokens long")
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_summary(histogram: DataFrame) -> DataFrame:
    """One row per occurring length, as context limit, with the totals at that limit.

    n_docs have exactly this length, docs_within at most, docs_over more. tokens_within and
    tokens_over are their tokens, truncated_tokens the sum of min(length, limit), lost_tokens the
    rest, quantile the share of documents within. The sums run inside stretches of lengths and
    over the stretches' totals, so no task holds the whole histogram.
    """
    own = stored(histogram, "length-histogram").select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / STRETCH).alias("stretch")
    )
    totals = own.groupBy("stretch").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifts = totals.select(
        "stretch",
        F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    up_to = Window.partitionBy("stretch").orderBy("n_tokens")
    summed = own.join(shifts, "stretch").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(up_to)).alias("docs_within"),
        (F.col("tokens_before") + F.sum("tokens").over(up_to)).alias("tokens_within"),
        "all_docs",
        "all_tokens",
    )
    over = F.col("all_docs") - F.col("docs_within")
    cut = F.col("tokens_within") + F.col("context_limit") * over
    return summed.select(
        "context_limit",
        "n_docs",
        "docs_within",
        over.alias("docs_over"),
        F.col("all_tokens").alias("total_tokens"),
        "tokens_within",
        (F.col("all_tokens") - F.col("tokens_within")).alias("tokens_over"),
        cut.alias("truncated_tokens"),
        (F.col("all_tokens") - cut).alias("lost_tokens"),
        (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row for any limit, also one that no document has as its length: truncated_tokens."""
    return histogram.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"))


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the least length within which at least ``share`` of the documents lie (null if there are none)."""
    return context_summary(histogram).filter(F.col("quantile") >= share).agg(F.min("context_limit").alias("n_tokens"))
