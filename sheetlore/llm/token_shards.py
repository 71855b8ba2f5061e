"""Training-order materialisation of token ids.

Texts are tokenised and cut into sequences of fixed length. A keyed Feistel network, walked along its
cycles until it stays below the number of sequences, is a permutation: it gives every sequence one slot
of a global order that looks random and that anyone with the key can compute. Range partitions of the
slots write shards in which every sequence has the same number of bytes, so slot s lies in shard
s // per_shard at byte (s % per_shard) * stride, and reading can resume anywhere.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetlore.llm.common import local_text, map_texts, mix, python_ready, sorted_groups, stored

LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 256, 20240501, 6
#: Fixed value: the pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict = {}


def feistel(x: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0..size-1: a balanced Feistel network on the least even number of bits that
    hold ``size`` values, applied again to what falls outside."""
    half = max(1, (max(1, int(size) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key % 2**64))
    out = np.array(x, np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= np.uint64(size)]
    return out.astype(np.int64)


def _tokenizer(ranks: dict[bytes, int], name: str):
    import tiktoken

    if name not in _ENCODINGS:
        _ENCODINGS.clear()
        _ENCODINGS[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


def sequences(docs: DataFrame, ranks_file: str, doc_id: str, text: str, length: int) -> DataFrame:
    """Sequences of token ids, each as little-endian 16-bit numbers: place, doc_id, part, n_tokens, tokens."""
    python_ready(docs.sparkSession)
    ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, local_text(ranks_file).splitlines())}
    if max(ranks.values()) >= 2**16:
        raise ValueError("token ids of this vocabulary need more than 16 bits")
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), ranks_file

    def cut(texts: list[str]) -> list[list]:
        encoding = _tokenizer(shared.value, name)
        out = []
        for t in texts:
            ids = np.array(encoding.encode_ordinary(t), "<u2")
            out.append([ids[k : k + length].tobytes() for k in range(0, len(ids), length)])
        return [pa.array(out, pa.list_(pa.binary()))]

    cut_rows = map_texts(docs, doc_id, text, {"parts": "array<binary>"}, cut)
    return cut_rows.select("doc_id", F.posexplode("parts").alias("part", "tokens")).withColumn("place", F.monotonically_increasing_id())


def numbered(rows: DataFrame) -> DataFrame:
    """Stored sequences with their number 0..n-1 in the order of ``place``.

    ``place`` has the writing task in its upper bits and counts on in the lower ones, so a task's
    first number is the count of the tasks before it: one small row a task is summed, nothing moves.
    """
    task = F.shiftright("place", 33)
    counts = rows.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    first = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("first"))
    joined = rows.withColumn("task", task).join(F.broadcast(first), "task")  # a row for each task that wrote
    return joined.withColumn("number", F.col("first") + F.col("place").bitwiseAND(2**33 - 1)).drop("task", "first", "place")


def training_shards(
    docs: DataFrame, ranks_file: str, doc_id: str = "doc_id", text: str = "text",
    length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY,
) -> DataFrame:
    """One row per shard, in range partitions by shard.

    Returns shard, first_slot, n_sequences, stride (bytes a sequence), n_tokens, doc_ids and parts
    (of each slot, in order), lengths (tokens before the padding), payload (binary) and its digest.
    The last sequence of a text is padded with zeros. Null and empty texts have no sequence; repeated
    rows have theirs again; a null id is passed on. Strings of special tokens are ordinary text.
    """
    rows = stored(sequences(docs, ranks_file, doc_id, text, length), "sequences")
    total = rows.count()
    kind = docs.schema[doc_id].dataType.simpleString()

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = feistel(np.asarray(batch.column("number")), total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // per_shard), pa.array(slot), *(batch.column(c) for c in ("doc_id", "part", "tokens"))],
                ["shard", "slot", "doc_id", "part", "tokens"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = 2 * length
        for group in sorted_groups(batches):
            tokens = group.column("tokens").to_pylist()
            payload = b"".join([t.ljust(stride, b"\0") for t in tokens])
            lengths = [len(t) // 2 for t in tokens]
            yield pa.RecordBatch.from_pylist([{
                "shard": group.column("shard")[0].as_py(), "first_slot": group.column("slot")[0].as_py(), "n_sequences": len(tokens),
                "stride": stride, "n_tokens": sum(lengths), "doc_ids": group.column("doc_id").to_pylist(),
                "parts": group.column("part").to_pylist(), "lengths": lengths, "payload": payload,
                "payload_sha256": hashlib.sha256(payload).hexdigest(),
            }], schema=shape)

    placed = numbered(rows).select("number", "doc_id", "part", "tokens").mapInArrow(
        slots, f"shard long, slot long, doc_id {kind}, part int, tokens binary"
    )
    kinds = (
        f"shard long, first_slot long, n_sequences long, stride long, n_tokens long, doc_ids array<{kind}>, "
        "parts array<int>, lengths array<long>, payload binary, payload_sha256 string"
    )
    shape = pa.schema([
        ("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int64()), ("stride", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(rows_type(kind))), ("parts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64())),
        ("payload", pa.binary()), ("payload_sha256", pa.string()),
    ])
    return placed.repartitionByRange("shard").sortWithinPartitions("shard", "slot").mapInArrow(write, kinds)


def rows_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def write_shards(shards: DataFrame, path: str) -> None:
    """Write what is not yet there: shards already stored below ``path`` are left as they are.

    Spark commits a run's files together, so an interrupted run leaves no part of a shard, and the
    next run adds the missing ones.
    """
    spark: SparkSession = shards.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        shards = shards.join(spark.read.parquet(path).select("shard"), "shard", "left_anti")
    shards.write.mode("append").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, per_shard: int = PER_SHARD) -> DataFrame:
    """Sequences from ``slot`` on, in order: slot, doc_id, part, tokens (without padding)."""
    shards = spark.read.parquet(path).filter(F.col("shard") >= slot // per_shard)
    each = shards.select("first_slot", "stride", "payload", F.posexplode(F.arrays_zip("doc_ids", "parts", "lengths")).alias("k", "s"))
    tokens = F.substring("payload", F.col("k") * F.col("stride").cast("int") + 1, (F.col("s.lengths") * 2).cast("int"))
    rows = each.select((F.col("first_slot") + F.col("k")).alias("slot"), F.col("s.doc_ids").alias("doc_id"), F.col("s.parts").alias("part"), tokens.alias("tokens"))
    return rows.filter(F.col("slot") >= slot).orderBy("slot")
