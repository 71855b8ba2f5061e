"""A stored full-text index: positional postings in blocks, a term dictionary, segments that follow changes.

A segment holds the documents of one batch of changes. Its postings are blocks: one row per term and
stretch of documents, with arrays of ids, counts, lengths and word positions and, beside them, the
greatest count and least length, from which the block's best score follows. A stretch is inverted where
its texts are read, so only finished blocks are shuffled. Blocks of about the same size are sorted by term
and cut into folders of about equal size, and a dictionary names the first and last term of each folder,
so words and prefixes alike read few folders, by partition. Positions rise inside a document, with a gap
between columns that no phrase can bridge; the file format stores them as differences.

A later segment lists the ids that it supersedes. Readers leave those out of earlier segments. A batch
that is replayed overwrites its own segment, and segments are merged into one when there are many.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from sheetlore.operators.search import B, COLUMN_END, HITS, K1, WORD, query_words, query_words_in_order, rank, words_of
from sheetlore.session import cut_lineage, listed, ship_package

#: Documents in a block's stretch as a power of two, and the postings that one folder is meant to hold.
BLOCK_BITS = 8
POSTINGS_PER_FOLDER = 4_000_000
#: Rows that an inverting task gets at once, words it inverts together and blocks it passes on at once.
TEXTS, WORDS, ROWS = 1024, 1_000_000, 16_384
#: Blocks whose counts of postings lie between two powers of this are cut into folders together.
SIZES = 4
#: Segments beside each other before they are merged.
MOST_SEGMENTS = 8
#: Blocks that the first pass of a ranked search scores.
FIRST_BLOCKS = 16
#: Scores are rounded to this; a block whose bound is less below the worst hit is looked at.
ROUNDING = 6
_LAST = chr(0x10FFFF)
_SEGMENTS = "number long, folder string, batch long"


@dataclass(frozen=True)
class Segment:
    number: int
    folder: str
    batch: int


def positioned(corpus: DataFrame) -> DataFrame:
    """(id, n_words, words): words (struct of term and position) of each text, one more place between columns."""
    columns = F.transform(F.split("text", COLUMN_END), words_of)
    gapped = F.flatten(F.transform(columns, lambda w: F.concat(w, F.array(F.lit(None).cast("string")))))
    placed = F.filter(F.transform(gapped, lambda w, k: F.struct(w.alias("term"), k.alias("position"))), lambda x: x["term"].isNotNull())
    return corpus.select("id", placed.alias("words")).withColumn("n_words", F.size("words"))


def _blocks(corpus: DataFrame, bits: int) -> DataFrame:
    """Blocks of a corpus (id, text): term, block, n, max_tf, min_words, docs.

    A stretch is consecutive rows of a partition, so its blocks are made in the task that has them.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS:
        spark.conf.set(key, TEXTS)
    numbered = positioned(corpus).withColumn("block", F.shiftright(F.monotonically_increasing_id(), bits))
    rows = numbered.select("block", "id", "n_words", F.col("words.term").alias("terms"), F.col("words.position").alias("positions"))
    one = StructType([corpus.schema["id"]]).simpleString()[:-1]
    kind = f"term string, block long, n long, max_tf int, min_words int, docs array<{one},tf:int,n_words:int,positions:array<int>>>"
    return rows.mapInArrow(_inverted, kind)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (block, id, n_words, terms, positions) in order of block."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        block = table.column("block").to_numpy()
        whole = int(np.searchsorted(block, block[-1])) if len(block) else 0
        yield from _of_whole_stretches(table.slice(0, whole))
        rest = table.slice(whole)
    if rest is not None:
        yield from _of_whole_stretches(rest)


def _of_whole_stretches(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Some stretches at a time, so that a task holds few words."""
    if not rows.num_rows:
        return
    block, n_words = rows.column("block").to_numpy(), rows.column("n_words").fill_null(0).to_numpy()
    before = np.concatenate(([0], np.cumsum(n_words, dtype=np.int64)))
    begin, ends = 0, [*(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
    for end, after in zip(ends, [*ends[1:], None], strict=True):
        if after is None or before[after] - before[begin] > WORDS:
            yield from _invert(rows.slice(begin, end - begin).combine_chunks())
            begin = end


def _invert(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.take(pa.compute.sort_indices(rows, [("block", "ascending"), ("id", "ascending")])).combine_chunks()
    lists = rows.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    if not len(coded):
        return
    size, block = rows.num_rows, rows.column("block").to_numpy()
    stretch = np.concatenate(([0], np.cumsum(block[1:] != block[:-1])))
    doc = np.repeat(np.arange(size), pa.compute.list_value_length(lists).fill_null(0).to_numpy())
    key = (stretch[doc] * len(coded.dictionary) + coded.indices.to_numpy()) * size + doc
    order = np.argsort(key, kind="stable")  # positions rise in a document
    key = key[order]
    places = rows.column("positions").combine_chunks().flatten().take(pa.array(order))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # of each posting's places
    tf = np.diff(np.append(first, len(key))).astype(np.int32)
    group, doc = np.divmod(key[first], size)
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))  # of each block's postings
    n_words = rows.column("n_words").fill_null(0).to_numpy()[doc].astype(np.int32)
    postings = pa.StructArray.from_arrays(
        [rows.column("id").combine_chunks().take(pa.array(doc)), pa.array(tf), pa.array(n_words), pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), places)],
        ["id", "tf", "n_words", "positions"],
    )
    stretch, code = np.divmod(group[head], len(coded.dictionary))
    start = np.concatenate(([True], block[1:] != block[:-1]))
    blocks = pa.RecordBatch.from_arrays(
        [
            coded.dictionary.take(pa.array(code)), pa.array(block[start][stretch]), pa.array(np.diff(np.append(head, len(first))).astype(np.int64)),
            pa.array(np.maximum.reduceat(tf, head)), pa.array(np.minimum.reduceat(n_words, head)),
            pa.ListArray.from_arrays(pa.array(np.append(head, len(first)), pa.int32()), postings),
        ],
        ["term", "block", "n", "max_tf", "min_words", "docs"],
    )
    for begin in range(0, blocks.num_rows, ROWS):
        yield blocks.slice(begin, ROWS)


def _grouped(postings: DataFrame) -> DataFrame:
    """Blocks of postings (term, block, id, tf, n_words, positions)."""
    return postings.groupBy("term", "block").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("n_words").alias("min_words"),
        F.sort_array(F.collect_list(F.struct("id", "tf", "n_words", "positions"))).alias("docs"),
    )


class StoredIndex:
    """An index in a folder that all executors share. Ids are unique in a corpus and in a batch of changes."""

    def __init__(self, spark: SparkSession, path: str, per_folder: int = POSTINGS_PER_FOLDER, block_bits: int = BLOCK_BITS):
        self.spark, self.path, self.per_folder, self.block_bits = spark, path, per_folder, block_bits

    # --- writing ---------------------------------------------------------------------------------

    def create(self, corpus: DataFrame) -> StoredIndex:
        """A first segment with a whole corpus (id, text); what the folder held is not read any more."""
        folder = self._write_segment(f"new-{uuid.uuid4().hex}", corpus, None, [])
        self._set([Segment(0, folder, -1)])
        return self

    def apply(self, batch: int, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Take in a batch: ``changed`` (id, text) was added or amended, ``removed`` (id) deleted.

        Batches come in order of their number. One that comes again replaces what it wrote, or is
        skipped if it has been merged.
        """
        segments = self.segments()
        last = max((s.batch for s in segments), default=-1)
        if batch < last or any(s.batch == batch and s.folder.startswith("merged") for s in segments):
            return
        before = [s for s in segments if s.batch != batch]
        gone = changed.select("id") if removed is None else changed.select("id").unionByName(removed.select("id"))
        folder = self._write_segment(f"batch-{batch}", changed, gone.distinct(), before)
        number = max((s.number for s in before), default=-1) + 1
        self._set([*before, Segment(number, folder, batch)])
        if len(before) + 1 > MOST_SEGMENTS:
            self.merge()

    def follow(self, changes: DataFrame, checkpoint: str, last_by: str | None = None) -> StreamingQuery:
        """Start taking in a stream of (id, text); a null text removes the document. ``last_by`` orders changes of one id."""

        def take_in(rows: DataFrame, batch: int) -> None:
            if last_by:
                latest = rows.groupBy("id").agg(F.max_by(F.struct("text"), last_by).alias("v")).select("id", "v.text")
            else:
                latest = rows.select("id", "text")
            latest = latest.persist()
            self.apply(batch, latest.filter("text IS NOT NULL"), latest.filter("text IS NULL"))
            latest.unpersist()

        return changes.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def merge(self) -> None:
        """All segments as one, without what is superseded; its blocks are full again."""
        segments = self.segments()
        live = self.postings()
        folder = f"merged-{uuid.uuid4().hex}"
        # the stretches of several small segments are dealt out anew, each document to one stretch
        stretch = F.pmod(F.xxhash64("id"), F.lit((self._documents(segments) >> self.block_bits) + 1))
        self._write_blocks(folder, _grouped(live.withColumn("block", stretch)))
        facts = self.facts()
        facts.write.parquet(f"{self.path}/{folder}/facts")
        self._lengths(segments).write.parquet(f"{self.path}/{folder}/lengths")
        self.spark.createDataFrame([], live.select("id").schema).write.parquet(f"{self.path}/{folder}/superseded")
        self._set([Segment(0, folder, max(s.batch for s in segments))])

    def _write_segment(self, folder: str, corpus: DataFrame, gone: DataFrame | None, before: list[Segment]) -> str:
        home = f"{self.path}/{folder}"
        self._write_blocks(folder, _blocks(corpus, self.block_bits))
        corpus.select("id", F.size(words_of(F.col("text"))).alias("n_words")).write.mode("overwrite").parquet(f"{home}/lengths")
        lengths = self.spark.read.parquet(f"{home}/lengths")
        superseded = gone if gone is not None else corpus.select("id").limit(0)
        superseded.write.mode("overwrite").parquet(f"{home}/superseded")
        added = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"))
        if before and gone is not None:
            lost = self._lengths(before).join(self.spark.read.parquet(f"{home}/superseded"), "id", "left_semi")
            taken = lost.agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum("n_words"), F.lit(0))).alias("n_words"))
            added = added.unionByName(taken).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))
        added.write.mode("overwrite").parquet(f"{home}/facts")
        return folder

    def _write_blocks(self, folder: str, blocks: DataFrame) -> None:
        """Blocks in folders that are ranges of terms, and the first and last term of each.

        Ranges have equal numbers of rows, so blocks of like size are cut together: a common word's
        blocks hold hundreds of postings, a rare one's a single one.
        """
        home = f"{self.path}/{folder}"
        sized = blocks.withColumn("size", F.floor(F.log(float(SIZES), F.col("n") + 0.5)).cast("int"))
        sized.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("size").parquet(f"{home}/unsorted")
        rows = self.spark.read.schema(sized.schema).parquet(f"{home}/unsorted")
        sums = rows.groupBy("size").agg(F.sum("n").alias("n")).orderBy("size").collect()  # a row per power of SIZES
        begin = 0
        for k, r in enumerate(sums or [{"size": 0, "n": 0}]):
            folders = max(1, -(-r["n"] // self.per_folder))
            own = rows.filter(F.col("size") == r["size"]).drop("size")
            ranged = own.repartitionByRange(folders, "term", "block").sortWithinPartitions("term", "block").withColumn("bucket", F.spark_partition_id() + begin)
            writer = ranged.write.mode("append" if k else "overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket")
            writer = writer.option("parquet.writer.version", "PARQUET_2_0")
            writer.option("parquet.enable.dictionary#docs.list.element.positions.list.element", "false").parquet(f"{home}/postings")
            begin += folders
        written = self.spark.read.schema(_with_bucket(blocks)).parquet(f"{home}/postings")
        dictionary = written.groupBy("bucket").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("blocks"))
        dictionary.write.mode("overwrite").parquet(f"{home}/dictionary")
        self.spark.createDataFrame([], blocks.schema).write.mode("overwrite").parquet(f"{home}/unsorted")  # its schema stays

    def _set(self, segments: list[Segment]) -> None:
        """The list of segments is a new folder each time; the last complete one counts."""
        rows = [(s.number, s.folder, s.batch) for s in segments]
        self.spark.createDataFrame(rows, _SEGMENTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list/{self._version() + 1}")

    # --- reading ---------------------------------------------------------------------------------

    def _version(self) -> int:
        found = [int(name) for name, _, _ in listed(self.spark, f"{self.path}/list")]
        complete = [n for n in found if any(name == "_SUCCESS" for name, _, _ in listed(self.spark, f"{self.path}/list/{n}"))]
        return max(complete, default=0)

    def segments(self) -> list[Segment]:
        version = self._version()
        if not version:
            return []
        rows = self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/list/{version}").collect()
        return sorted((Segment(r["number"], r["folder"], r["batch"]) for r in rows), key=lambda s: s.number)

    def _documents(self, segments: list[Segment]) -> int:
        return int(reduce(DataFrame.unionByName, [self._read(s, "facts") for s in segments]).agg(F.sum("n_docs")).first()[0] or 0)

    def _read(self, segment: Segment, part: str) -> DataFrame:
        home = f"{self.path}/{segment.folder}"
        if part == "postings":
            return self.spark.read.schema(_with_bucket(self.spark.read.parquet(f"{home}/unsorted"))).parquet(f"{home}/postings")
        return self.spark.read.parquet(f"{home}/{part}")

    def _superseded(self, segment: Segment, among: list[Segment]) -> DataFrame | None:
        """Ids of a segment's documents that later ones replaced or removed."""
        later = [self._read(s, "superseded") for s in among if s.number > segment.number]
        return reduce(DataFrame.unionByName, later).distinct() if later else None

    def _lengths(self, segments: list[Segment]) -> DataFrame:
        """id, n_words of the documents that stand."""
        parts = []
        for s in segments:
            gone, own = self._superseded(s, segments), self._read(s, "lengths")
            parts.append(own if gone is None else own.join(gone, "id", "left_anti"))
        return reduce(DataFrame.unionByName, parts)

    def facts(self) -> DataFrame:
        """Number of documents and their length in words."""
        every = reduce(DataFrame.unionByName, [self._read(s, "facts") for s in self.segments()])
        return every.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))

    def folders(self, segment: Segment, terms: list[str], prefix: bool = False) -> list[int]:
        """Folders of a segment that may hold the terms, or terms that begin with them, by its dictionary."""
        test = F.lit(False)
        for t in terms:
            test = test | ((F.col("first") <= (t + _LAST if prefix else t)) & (F.col("last") >= t))
        return sorted(r["bucket"] for r in self._read(segment, "dictionary").filter(test).select("bucket").collect())

    def blocks(self, terms: list[str] | None = None, prefix: bool = False) -> list[tuple[Segment, DataFrame]]:
        """Blocks of the given terms (of all without any), per segment; only their folders are read."""
        found = []
        for s in self.segments():
            rows = self._read(s, "postings")
            if terms is not None:
                test = reduce(Column.__or__, [F.col("term").startswith(t) for t in terms]) if prefix else F.col("term").isin(terms)
                rows = rows.filter(F.col("bucket").isin(self.folders(s, terms, prefix)) & test)
            found.append((s, rows.drop("bucket")))
        return found

    def postings(self, terms: list[str] | None = None, prefix: bool = False, positions: bool = True) -> DataFrame:
        """term, id, tf, n_words (and positions) of the documents that stand."""
        segments, parts = self.segments(), []
        columns = ["term", "d.id", "d.tf", "d.n_words", *(["d.positions"] if positions else [])]
        for s, rows in self.blocks(terms, prefix):
            each = rows.select("term", F.explode("docs").alias("d")).select(*columns)
            gone = self._superseded(s, segments)
            parts.append(each if gone is None else each.join(gone, "id", "left_anti").select(*each.columns))
        return reduce(DataFrame.unionByName, parts)

    # --- queries ---------------------------------------------------------------------------------

    def match_all(self, terms: list[str]) -> DataFrame:
        """Documents that hold every word."""
        held = self.postings(terms, positions=False).groupBy("id").agg(F.count_distinct("term").alias("n"))
        return held.filter(F.col("n") == len(set(terms))).select("id")

    def match_prefix(self, prefixes: list[str]) -> DataFrame:
        """Documents in which every prefix starts some word."""
        low = sorted({p.lower() for p in prefixes})
        hits = self.postings(low, prefix=True, positions=False)
        started = F.array_compact(F.array(*[F.when(F.col("term").startswith(p), F.lit(k)) for k, p in enumerate(low)]))
        found = hits.select("id", F.explode(started).alias("slot")).groupBy("id").agg(F.count_distinct("slot").alias("n"))
        return found.filter(F.col("n") == len(low)).select("id")

    def phrase_hits(self, phrase: str) -> DataFrame:
        """id, tf, n_words of the documents that hold the phrase's words next to each other, from positions alone.

        The places of each word, shifted back by its place in the phrase, are intersected word by word.
        """
        words = query_words_in_order(phrase)
        distinct = list(dict.fromkeys(words))
        rows = self.postings(distinct)
        by_doc = rows.groupBy("id", "n_words").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
        starts = F.col("places")[words[0]]
        for k, word in enumerate(words[1:], 1):
            starts = F.array_intersect(starts, _moved_back(F.col("places")[word], k))
        found = by_doc.filter(F.size("places") == len(distinct)).select("id", "n_words", F.size(starts).alias("tf"))
        return found.filter("tf > 0").select("id", "tf", "n_words")

    def match_phrase(self, phrase: str) -> DataFrame:
        return self.phrase_hits(phrase).select("id")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many documents each term stands; from the blocks' counts, if nothing is superseded."""
        segments, counts = self.segments(), []
        for s, rows in self.blocks(terms):
            gone = self._superseded(s, segments)
            if gone is None:
                counts.append(rows.select("term", "n"))
            else:
                ids = rows.select("term", F.explode("docs.id").alias("id"))
                counts.append(ids.join(gone, "id", "left_anti").select("term", F.lit(1).cast("long").alias("n")))
        sums = reduce(DataFrame.unionByName, counts).groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in sums.collect()}  # one row per query word

    def search(self, text: str, limit: int = HITS) -> DataFrame:
        """Best documents that hold all words of a text, by Okapi BM25, without scoring all that hold them.

        The blocks in which all words stand have an upper bound of their scores. The best ones are
        scored first; a second pass scores those whose bound reaches the worst hit found. Equal to
        ``rank`` over all postings.
        """
        return self.search_with_blocks(text, limit)[0]

    def search_with_blocks(self, text: str, limit: int = HITS) -> tuple[DataFrame, int, int]:
        """The result of ``search``, and how many of how many blocks were scored."""
        terms = query_words(text)
        facts = self.facts().first()
        frequency = self.frequencies(terms)
        if len(frequency) < len(terms):
            return self._scored(terms, {t: 1 for t in terms}, 1, 1.0, None).limit(0), 0, 0
        n_docs, mean = facts["n_docs"], facts["n_words"] / facts["n_docs"]
        bounds = None
        for s, rows in self.blocks(terms):
            best = _weight(F.col("max_tf"), F.col("min_words"), mean) * _idf(frequency, n_docs)
            own = rows.select(F.lit(s.number).alias("segment"), "block", "term", best.alias("best"))
            bounds = own if bounds is None else bounds.unionByName(own)
        whole = bounds.groupBy("segment", "block").agg(F.count("*").alias("n"), F.sum("best").alias("bound")).filter(F.col("n") == len(terms))
        whole = cut_lineage(whole)  # one row of numbers per block
        total = whole.count()
        top = whole.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS).select("segment", "block")
        first = self._scored(terms, frequency, n_docs, mean, top).orderBy(F.desc("score"), "id").limit(limit).collect()
        if len(first) < limit:
            chosen = whole.select("segment", "block")
        else:
            chosen = whole.filter(F.col("bound") >= first[-1]["score"] - 10.0**-ROUNDING).select("segment", "block")
        scored = max(chosen.count(), min(total, FIRST_BLOCKS))
        hits = self._scored(terms, frequency, n_docs, mean, chosen)
        return hits.orderBy(F.desc("score"), "id").limit(limit), scored, total

    def _scored(self, terms: list[str], frequency: dict[str, int], n_docs: int, mean: float, chosen: DataFrame | None) -> DataFrame:
        """id, score of the documents in the chosen blocks that hold all terms."""
        segments, parts = self.segments(), []
        for s, rows in self.blocks(terms):
            if chosen is not None:
                rows = rows.join(chosen.filter(F.col("segment") == s.number).select("block"), "block", "left_semi")
            each = rows.select("term", F.explode("docs").alias("d")).select("term", "d.id", "d.tf", "d.n_words")
            gone = self._superseded(s, segments)
            parts.append(each if gone is None else each.join(gone, "id", "left_anti").select(*each.columns))
        weight = _weight(F.col("tf"), F.col("n_words"), mean) * _idf(frequency, n_docs)
        sums = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(weight), ROUNDING).alias("score"))
        return sums.filter(F.col("n") == len(terms)).select("id", "score")

    def ranked(self, text: str, limit: int = HITS) -> DataFrame:
        """Best documents for words, ``prefix*`` and ``"a phrase"`` together, by Okapi BM25.

        Every part counts like a word: a phrase as often as it stands in a document, a prefix as
        often as words begin with it, both with the number of documents that have them.
        """
        import regex

        phrases = [p for p in regex.findall(r'"([^"]*)"', text) if query_words(p)]
        rest = regex.sub(r'"[^"]*"', " ", text)
        prefixes = [w.lower() for w in regex.findall(rf"({WORD})\*", rest)]
        words = query_words(regex.sub(rf"{WORD}\*", " ", rest))
        if not (phrases or prefixes):
            return self.search(text, limit)
        parts = [self.postings([w], positions=False).select(F.lit(f"w{k}").alias("term"), "id", "tf", "n_words") for k, w in enumerate(words)]
        for k, p in enumerate(dict.fromkeys(prefixes)):
            started = self.postings([p], prefix=True, positions=False).groupBy("id", "n_words").agg(F.sum("tf").alias("tf"))
            parts.append(started.select(F.lit(f"p{k}").alias("term"), "id", "tf", "n_words"))
        for k, p in enumerate(dict.fromkeys(phrases)):
            parts.append(self.phrase_hits(p).select(F.lit(f"q{k}").alias("term"), "id", "tf", "n_words"))
        return rank(reduce(DataFrame.unionByName, parts), self.facts(), len(parts), limit)


def _moved_back(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _weight(tf: Column, n_words: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words / F.lit(mean)))


def _idf(frequency: dict[str, int], n_docs: int) -> Column:
    by_term = F.create_map(*[F.lit(x) for t, n in frequency.items() for x in (t, n)])[F.col("term")]
    return F.log(1 + (F.lit(n_docs) - by_term + 0.5) / (by_term + 0.5))


def _with_bucket(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields]).add("bucket", IntegerType())
