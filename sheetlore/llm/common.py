"""Helpers shared by the corpus operators: shared-folder tables, folds, naming and vectorised word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlore.session import ensure_checkpoint_dir, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read again.

    Column-pruned re-reads are cheaper than a checkpoint's, and a lost executor costs nothing:
    the files lie in the shared store.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def ascii_lower(text: Column) -> Column:
    """Only A-Z are folded; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem = f"_{stem}"
    return stem


def row_key(df: DataFrame, doc_id: str, text: str) -> Column:
    """(id, mark): tells apart rows that share an id, or have none, by a hash of their texts; null texts count as empty."""
    return F.struct(df[doc_id].alias("id"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("mark"))


#: Rows that Spark hands to a Python task at once, at most: they hold whole texts.
ROWS_AT_ONCE = 1024


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in Python workers on every executor, and let them get few rows at once."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, ROWS_AT_ONCE)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task that gives its memory back when it ends; a worker lives on with the next task."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # other C libraries do so by themselves
                ctypes.CDLL(None).malloc_trim(0)

    return task


def local_text(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


# --- vectorised word hashing -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
#: Bytes hashed together; a longer word is not cut.
STRETCH_BYTES = 1 << 18
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _STEP, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(
    texts: list[str | None], prefixes: tuple[int, ...] = (), within: np.ndarray = ~_SPACE
) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one entry more than texts).

    Words are runs of the bytes marked in ``within`` (by default runs without U+0020 and
    U+0009..U+000D) after lower-casing A-Z. For each of ``prefixes`` a further array has the hash of
    that many first bytes of a word, 0 for shorter words. The texts of a batch are hashed together
    over their UTF-8 bytes; there is no loop over words.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = FOLDED[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts, found = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(1 + len(prefixes))]
    begin = 0
    while begin < len(data):
        end = _word_border(data, begin + STRETCH_BYTES, within)
        at, *hashes = _stretch_hashes(data[begin:end], prefixes, within)
        starts.append(at + begin)
        for kept, new in zip(found, hashes, strict=True):
            kept.append(new)
        begin = end
    joined = [np.concatenate(x) for x in found]
    return joined[0], np.searchsorted(np.concatenate(starts), begins), *joined[1:]


def _word_border(data: np.ndarray, at: int, within: np.ndarray) -> int:
    """The first place from ``at`` on that no word reaches across."""
    while at < len(data):
        outside = np.flatnonzero(~within[data[at : at + 4096]])
        if len(outside):
            return at + int(outside[0])
        at += 4096
    return len(data)


def _stretch_hashes(data: np.ndarray, prefixes: tuple[int, ...], within: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts of the words in some bytes, their hashes and those of their prefixes."""
    inside = within[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return (starts, *(np.zeros(0, np.uint64) for _ in range(1 + len(prefixes))))
    lengths = ends - starts
    at = np.flatnonzero(inside)
    word_begin = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(word_begin, lengths)
    power = _POWERS[place % len(_POWERS)]
    far = place >= len(_POWERS)
    if far.any():  # words of more than 4096 bytes: later stretches get another weight
        power[far] = mix(place[far].astype(np.uint64))
    weighted = _BYTE[data[at]] * power
    hashes = mix(np.add.reduceat(weighted, word_begin) + lengths.astype(np.uint64) * _STEP)
    more = []
    if prefixes:
        up_to = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)))
        for k in prefixes:
            end = np.minimum(word_begin + k, len(at))
            first = mix(up_to[end] - up_to[word_begin] + np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64))
            more.append(np.where(lengths >= k, first, np.uint64(0)))
    return starts, hashes, *more


#: Letters, digits and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def map_texts(docs: DataFrame, doc_id: str, text: str, columns: dict[str, str], score=None, start=None) -> DataFrame:
    """doc_id and the columns that ``score(texts)`` gives for the whole texts of a batch (null: empty).

    ``score`` returns one list or array per column, in order. Instead, ``start()`` makes one for each task,
    which may keep things as long as the task runs. The id column is passed on as it is.
    """
    python_ready(docs.sparkSession)
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = start() if start else score
        for batch in parts(batches):
            found = [pa.array(x) for x in own(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], ["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), ", ".join([f"doc_id {kind}", *(f"{k} {v}" for k, v in columns.items())]))


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of a batch with a bounded amount of text (a longer text stands alone)."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield begin, end
        begin = end


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal values in the first column of a sorted stream, each as one table."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = np.asarray(table.column(0))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(begin, end - begin)
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest
