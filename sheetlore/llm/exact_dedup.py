"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of fixed size. Equal blocks get the same integer name, unequal
blocks different ones, because names are ranks of the sorted distinct blocks, not hashes. Adjacent
names are paired and the pairs named in the same way until one name is left; texts of equal length
in blocks are equal exactly if their last names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.llm.common import ascii_lower, stored, unused

BLOCK_BYTES = 4096
#: Blocks named apart from the others: so every other block has at most 1/257 of all occurrences.
HEAVY_BLOCKS = 256


def _names(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """A rank for each row: its partition, then its place in the sorted partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _occurrences(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """One row per block; the row number and the digest ride along with it."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        ascii_lower(F.col(text)).cast("binary").alias("body"),
    ).withColumn("rid", F.monotonically_increasing_id())
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes))
    )
    return rows.select("rid", "doc_id", F.sha2("body", 256).alias("text_sha256"), count.alias("n"), F.posexplode(blocks).alias("pos", "block"))


def _first_names(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """Occurrences with the names of their blocks.

    The most frequent blocks, whose number is fixed, get negative names by a broadcast of their
    texts. The others are sorted where the shuffle brings equal blocks together; the occurrences
    meet them there, so the text crosses the network once per side.
    """
    spark = docs.sparkSession
    occurrences = _occurrences(docs, doc_id, text, block_bytes).withColumn("mark", F.xxhash64("block"))
    frequent = (
        occurrences.groupBy("mark").count().filter("count > 16").orderBy(F.desc("count"), "mark").limit(HEAVY_BLOCKS)
    )
    marks = [row["mark"] for row in frequent.collect()]
    is_heavy: Column = F.col("mark").isin(marks) if marks else F.lit(False)
    heavy = spark.createDataFrame([], "block binary, heavy_name long")
    if marks:  # at most HEAVY_BLOCKS blocks of fixed size: a bounded broadcast
        seen = occurrences.filter(is_heavy).groupBy("block").agg(F.count("*").alias("n_seen"))
        heavy = stored(_names(seen, ["block"]).select("block", (-1 - F.col("name")).alias("heavy_name")), "heavy-blocks")
    # Row numbers are taken in one branch of one plan, whatever the input is. A heavy block's rows go
    # where their row number sends them; the first byte keeps such keys apart from blocks.
    own = F.concat(F.lit(b"\x01"), F.col("block"))
    left = occurrences.join(F.broadcast(heavy), "block", "left").withColumn(
        "key", F.when(F.col("heavy_name").isNull(), own).otherwise(F.concat(F.lit(b"\x00"), F.col("rid").cast("string").cast("binary")))
    )
    others = occurrences.filter(~is_heavy).groupBy(own.alias("key")).agg(F.count("*").alias("n_seen"))
    named = left.drop("block", "mark").join(_names(others, ["key"]).hint("merge"), "key", "left")
    return stored(
        named.select("rid", "doc_id", "text_sha256", "n", "pos", F.coalesce("heavy_name", "name").alias("name")), "block-names"
    )


def _paired(level: DataFrame) -> DataFrame:
    """Names of adjacent pairs, half as many per text. Distinct pairs are stored before they meet
    their occurrences, so that a pair with very many occurrences can be split among tasks."""
    half = F.floor(F.col("pos") / 2).cast("int")
    pairs = level.groupBy("rid", half.alias("pos")).agg(
        F.max("doc_id").alias("doc_id"),
        F.max("text_sha256").alias("text_sha256"),
        F.max("n").alias("n"),
        F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-(2**62))).alias("right"),
    )
    pairs = stored(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), "pairs")
    names = stored(_names(pairs.groupBy("left", "right").agg(F.count("*").alias("n_seen")), ["left", "right"]).drop("n_seen"), "pair-names")
    return stored(pairs.join(names, ["left", "right"]).select("rid", "doc_id", "text_sha256", "n", "pos", "name"), "named-pairs")


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: (rid, doc_id, text_sha256, level, name); equal (level, name) means equal text."""
    level, done = _first_names(docs, doc_id, text, block_bytes), None
    for depth in range(64):  # halves each time; ends when the longest text has one name
        ready = level.filter("n = 1").select("rid", "doc_id", "text_sha256", F.lit(depth).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        level = level.filter("n > 1")
        if level.isEmpty():
            break
        level = _paired(level)
    return done


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row with the row that stays for its text.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when identical after
    lower-casing A-Z; null counts as empty, and all empty texts form one group. The largest
    doc_id stays (a null id only where all are null); of rows repeated with their id, one stays.
    Other columns of the input are neither read nor returned. An empty table gives an empty one.
    """
    ids = identities(docs, doc_id, text, block_bytes)
    groups = stored(
        ids.groupBy("level", "name").agg(
            F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")
        ),
        "text-groups",
    )
    return ids.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
    )


def without_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows leave one."""
    own = unused(docs, "_text_sha256")
    kept = exact_duplicates(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    marked = docs.withColumn(own, F.sha2(ascii_lower(F.col(text)).cast("binary"), 256))
    same = (marked[own] == kept["_kept_sha"]) & marked[doc_id].eqNullSafe(kept["_kept_id"])
    return marked.join(kept, same, "left_semi").dropDuplicates([own, doc_id]).drop(own)
