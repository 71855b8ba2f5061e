"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping windows of words, benchmark items as passages. Both are weighted
by term frequency and inverse document frequency, counted over all documents, and projected on the
leading right singular vectors of the matrix of all passages and their terms, found by a distributed
randomised decomposition. Windows whose projection points where a benchmark passage's does are candidates; the
longest common subsequence of words, and that of the passage's answer, its end, decide. So a passage
is found again with words changed, dropped or put in between.

The benchmark is the query set: it is taken in blocks of bounded size, each against all documents.
Only the terms of a block's passages are kept, so every table that is broadcast has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlore.llm.common import LETTERS, map_texts, parts, python_ready, row_key, slices, sorted_groups, stored, tidy, word_hashes

#: Benchmark items searched together.
ITEMS = 512
#: Words of half a window; windows overlap by half.
HALF = 32
#: Longest passage; longer items are cut evenly, and once more from middle to middle of the cuts.
PASSAGE = 64
RANK, OVERSAMPLING, POWERS = 128, 8, 2
LEAST_COSINE, LEAST_LENGTH = 0.45, 0.35
#: Share of a passage's weight that must stand there: a passage with telling words needs some of them.
LEAST_WEIGHT = 0.35
#: A term is common if more than this share of all documents has it; passages made of such terms are found by counting words.
COMMON_TERM = 0.1
#: Windows compared at once, cells of a table of counted words, and candidates whose words are counted at once.
WINDOWS, CELLS, PAIRS = 8192, 2_000_000, 16_384
#: A document is contaminated with this share of an item's words in order, if the answer is among them ...
COMMON, ANSWER = 0.6, 0.5
#: ... or with this share, whatever is missing.
COMMON_ALONE = 0.8
#: A part of a longer item counts by itself with this many words without a gap, or with COMMON_ALONE of a passage.
RUN = 50
_BITS = 20


def _hashed(texts: list[str]) -> tuple[np.ndarray, ...]:
    return word_hashes([t.lower() for t in texts], (), LETTERS)


class Block:
    """Passages of one block of items and the tables by which documents are searched for them."""

    def __init__(self, items: list[tuple[object, str]]):
        hashes, bounds = _hashed([t for _, t in items])
        self.items, self.words, self.item_of = [i for i, _ in items], [], []
        self.begins, self.cut, self.whole = [], [], []
        self.lengths = np.diff(bounds)
        for k in range(len(items)):
            own = hashes[bounds[k] : bounds[k + 1]]
            cuts = np.cumsum([0, *map(len, np.array_split(own, max(1, -(-len(own) // PASSAGE))))])
            middles = (cuts[:-1] + cuts[1:]) // 2
            for edges in (cuts, middles):
                for begin, end in zip(edges[:-1], edges[1:], strict=True):
                    if begin < end:
                        self.words.append(own[begin:end])
                        self.item_of.append(k)
                        self.begins.append(int(begin))
                        self.cut.append(edges is cuts)
            self.whole.append(own)
        self.terms = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.marked = np.zeros(2**_BITS, bool)
        self.marked[self.terms >> np.uint64(64 - _BITS)] = True
        self.wanted = [np.unique(np.searchsorted(self.terms, w), return_counts=True) for w in self.words]
        self.passages_of = [[p for p, i in enumerate(self.item_of) if i == k] for k in range(len(items))]
        self.idf = np.ones(len(self.terms))
        self.common = np.zeros(len(self.terms), bool)
        self.counted: list[int] = []
        self.basis = np.zeros((len(self.terms), 0), np.float32)

    def weigh(self, documents: int, frequency: np.ndarray) -> None:
        """Inverse document frequencies, 1 at least; passages half of whose words are common ones are searched by counting."""
        self.idf = 1 + np.log((documents + 1) / (frequency + 1))
        self.common = frequency > COMMON_TERM * documents
        self.counted = [p for p, (terms, n) in enumerate(self.wanted) if 2 * n[self.common[terms]].sum() >= n.sum()]

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are terms, and which."""
        place = np.flatnonzero(self.marked[hashes >> np.uint64(64 - _BITS)])
        if not len(place):
            return place, place
        at = np.minimum(np.searchsorted(self.terms, hashes[place]), len(self.terms) - 1)
        same = self.terms[at] == hashes[place]
        return place[same], at[same]

    def passages(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and weights of each passage."""
        return [_vector(np.searchsorted(self.terms, w), self.idf) for w in self.words]

    def prepare(self) -> Block:
        """Tables that searching tasks share: latent weights of terms, passages as unit vectors, counted passages' terms."""
        self.table = (self.basis * self.idf[:, None]).astype(np.float32)
        self.common_column = np.where(self.common, np.cumsum(self.common) - 1, -1)
        self.common_table = self.table[self.common]
        vectors = [weights @ self.basis[terms] for terms, weights in self.passages()]
        queries = np.stack(vectors) if vectors else np.zeros((0, self.basis.shape[1]), np.float32)
        self.sizes = np.linalg.norm(queries, axis=1)
        self.unit = (queries / np.maximum(self.sizes, 1e-9)[:, None]).astype(np.float32)
        named = np.unique(np.concatenate([self.wanted[p][0] for p in self.counted])) if self.counted else np.zeros(0, np.int64)
        self.column = np.full(len(self.terms), -1, np.int64)
        self.column[named] = np.arange(len(named))
        self.asked = np.zeros((len(named), len(self.counted)), np.float32)
        for k, p in enumerate(self.counted):
            self.asked[self.column[self.wanted[p][0]], k] = self.wanted[p][1]
        self.latent = np.setdiff1d(np.arange(len(self.words)), self.counted)
        self.pairs = np.concatenate([p * len(self.terms) + terms for p, (terms, _) in enumerate(self.wanted)] or [np.zeros(0, np.int64)])  # rising
        self.often = np.concatenate([n for _, n in self.wanted] or [np.zeros(0, np.int64)])
        self.least_words = COMMON * np.array([len(w) for w in self.words]) - 1e-6
        self.least_weight = LEAST_WEIGHT * np.array([(n * self.idf[terms]).sum() for terms, n in self.wanted]) - 1e-6
        return self

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float, int, float]]:
        """Contaminated texts: (text, item, cosine, share of the item's words in order, of its answer's, best passage's first word, its share)."""
        for first, last in slices(texts, 1_000_000):
            hashes, bounds = _hashed(texts[first:last])
            halves = np.maximum(1, -(-np.diff(bounds) // HALF)) + 1  # one more, so that no window reaches into the next text
            offset = np.concatenate(([0], np.cumsum(halves)))
            place, term = self.hits(hashes)
            if not len(place):
                continue
            owner = np.searchsorted(bounds, place, "right") - 1
            half = offset[owner] + (place - bounds[owner]) // HALF
            found: dict[int, _Found] = {}
            for starts, passages in (*self._near(half, term), *self._counted(half, term, int(offset[-1]))):
                text = np.searchsorted(offset, starts, "right") - 1
                inside = starts - offset[text] < halves[text] - 1
                starts, passages, text = starts[inside], passages[inside], text[inside]
                some = self._enough(bounds[text], bounds[text + 1], starts - offset[text], passages, place, term)
                for s, p, t in zip(starts[some].tolist(), passages[some].tolist(), text[some].tolist(), strict=True):
                    if t not in found:
                        found[t] = _Found(self, hashes[bounds[t] : bounds[t + 1]])
                    found[t].look(p, s - int(offset[t]))
            for t in sorted(found):
                for item, *rest in found[t].decided():
                    yield first + t, item, *rest

    def _enough(self, first: np.ndarray, last: np.ndarray, half: np.ndarray, passages: np.ndarray, place: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which candidates have enough of the passage's words and weight around the window, as ``_Found.look`` asks; counted for many at once."""
        out = np.zeros(len(half), bool)
        begins, ends = _around(half)
        low, high = np.searchsorted(place, first + begins), np.searchsorted(place, np.minimum(first + ends, last))
        for k in range(0, len(half), PAIRS):
            own, n = passages[k : k + PAIRS], (high - low)[k : k + PAIRS]
            pair = np.repeat(np.arange(len(own)), n)
            at = term[np.arange(len(pair)) + np.repeat(low[k : k + PAIRS] - np.cumsum(n) + n, n)]
            code = own[pair] * len(self.terms) + at
            row = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            asked = self.pairs[row] == code
            code, count = np.unique(pair[asked] * len(self.pairs) + row[asked], return_counts=True)
            pair, row = np.divmod(code, len(self.pairs))
            overlap = np.minimum(count, self.often[row])
            words = np.bincount(pair, overlap, minlength=len(own))
            weight = np.bincount(pair, overlap * self.idf[self.pairs[row] % len(self.terms)], minlength=len(own))
            out[k : k + PAIRS] = (words >= self.least_words[own]) & (weight >= self.least_weight[own])
        return out

    def _near(self, half: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows whose projections point where a passage's does, some thousand at a time, and the passages.

        A window without a single uncommon term of the block shares less than half of the words of any
        passage that is searched so: too few to be found.
        """
        named = np.unique(half[~self.common[term]])
        starts = np.unique(np.concatenate((named, named - 1)))
        starts = starts[starts >= 0]
        for k in range(0, len(starts) if len(self.latent) else 0, WINDOWS):
            some = starts[k : k + WINDOWS]
            a, b = np.searchsorted(half, (some[0], some[-1] + 2))
            own, at = half[a:b], term[a:b]
            known, sums = self._sums(own, at)
            vectors = np.zeros((len(some), sums.shape[1]), np.float32)
            for shift in (0, 1):
                row = np.minimum(np.searchsorted(known, some + shift), len(known) - 1)
                there = known[row] == some + shift
                vectors[there] += sums[row[there]]
            size = np.linalg.norm(vectors, axis=1)
            dots = vectors @ self.unit[self.latent].T
            good = (dots >= LEAST_COSINE * size[:, None]) & (size[:, None] >= LEAST_LENGTH * self.sizes[self.latent][None, :]) & (dots > 0)
            window, passage = np.nonzero(good)
            yield some[window], self.latent[passage]

    def _sums(self, half: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves that have terms, and the sum of the terms' latent weights in each.

        Common terms are most of all words and few different ones: they are counted, and the counts multiplied.
        """
        known, row = np.unique(half, return_inverse=True)
        column = self.common_column[term]
        often = column >= 0
        width = len(self.common_table)
        counts = np.bincount(row[often] * width + column[often], minlength=len(known) * width).reshape(len(known), width)
        sums = counts.astype(np.float32) @ self.common_table
        row, term = row[~often], term[~often]
        if len(row):
            here = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            sums[row[here]] += np.add.reduceat(self.table[term], here, axis=0)
        return known, sums

    def _counted(self, half: np.ndarray, term: np.ndarray, halves: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows around which a share of COMMON of a counted passage's words may stand, and the passages.

        The bound is exact: a word counts as often as the passage has it if it stands there at all.
        """
        if not self.counted:
            return
        column = self.column[term]
        half, column = half[column >= 0], column[column >= 0]
        needed = COMMON * np.array([len(self.words[p]) for p in self.counted]) - 1e-6
        step = max(64, CELLS // len(self.asked))
        for begin in range(0, halves, step):
            a, b = np.searchsorted(half, (begin - 1, begin + step + 2))
            if a == b:
                continue
            there = np.zeros((step + 3, len(self.asked)), np.float32)  # from the half before the first window on
            there[half[a:b] - begin + 1, column[a:b]] = 1
            around = np.maximum(np.maximum(there[:-3], there[1:-2]), np.maximum(there[2:-1], there[3:]))
            window, passage = np.nonzero(around @ self.asked >= needed[None, :])
            yield begin + window, np.array(self.counted, np.int64)[passage]


class _Found:
    """What one text has of the passages that were searched."""

    def __init__(self, block: Block, hashes: np.ndarray):
        self.block, self.hashes = block, hashes
        self.best: dict[int, tuple[int, int, int]] = {}  # per passage: words in order, words of the answer, window
        self.run: dict[int, int] = {}

    def region(self, half: int) -> np.ndarray:
        begin, end = _around(half)
        return self.hashes[begin:end]

    def overlap(self, passage: int, half: int) -> np.ndarray:
        """How often the region has each of the passage's terms, no more often than the passage."""
        terms, wanted = self.block.wanted[passage]
        sought, region = self.block.terms[terms], self.region(half)
        at = np.minimum(np.searchsorted(sought, region), len(sought) - 1)
        return np.minimum(np.bincount(at[sought[at] == region], minlength=len(sought)), wanted)

    def bound(self, passage: int, half: int) -> int:
        """Words of the passage that the region has in any order: as many may stand in order, no more."""
        return int(self.overlap(passage, half).sum())

    def look(self, passage: int, half: int, least: float = COMMON) -> None:
        words = self.block.words[passage]
        before = self.best.get(passage, (0, 0, 0))[0]
        overlap = self.overlap(passage, half)
        bound = int(overlap.sum())
        terms, wanted = self.block.wanted[passage]
        if least and (overlap * self.block.idf[terms]).sum() < LEAST_WEIGHT * (wanted * self.block.idf[terms]).sum():
            return  # common words alone, which any text has somewhere in order
        if bound < least * len(words) - 1e-6 or (bound <= before and len(words) == self.block.lengths[self.block.item_of[passage]]):
            return
        region, item = self.region(half), self.block.item_of[passage]
        if bound > before:
            common, answer = common_words(words, region)
            if common > before:
                self.best[passage] = (common, answer, half)
        if least and len(words) < self.block.lengths[item] and self.run.get(item, 0) < RUN:  # a run of RUN words reaches the share in a passage
            self.run[item] = max(self.run.get(item, 0), longest_run(self.block.whole[item], region))

    def decided(self) -> Iterator[tuple[int, float, float, float, int, float]]:
        """(item, cosine, share in order, share of the answer, first word of the best passage, its share) of items contained."""
        block = self.block
        for item in sorted({block.item_of[p] for p in self.best}):
            own = block.passages_of[item]
            if len(own) > 1:  # a passage was found: the others may have less, anywhere in the text
                for half in range(max(1, -(-len(self.hashes) // HALF))):
                    for p in own:
                        if block.cut[p]:
                            self.look(p, half, 0.0)
            found = {p: self.best[p] for p in own if p in self.best}
            cut = [p for p in own if block.cut[p]]
            share = sum(found[p][0] for p in cut if p in found) / int(block.lengths[item])
            top = max(found, key=lambda p: (found[p][0] / len(block.words[p]), -p))
            part = found[top][0] / len(block.words[top])
            last = cut[-1]
            answer = found[last][1] / max(1, len(block.words[last]) // 4) if last in found else 0.0
            if max(share, part) >= COMMON_ALONE or (share >= COMMON and answer >= ANSWER) or self.run.get(item, 0) >= RUN:
                yield item, self.cosine(top, found[top][2]), share, answer, block.begins[top], part

    def cosine(self, passage: int, half: int) -> float:
        _, terms = self.block.hits(self.hashes[half * HALF : (half + 2) * HALF])
        vector = self.block.table[terms].sum(axis=0)
        return float(vector @ self.block.unit[passage] / max(1e-9, float(np.linalg.norm(vector))))


def _around(half):
    """First word of the region around a window, and the one after its last."""
    return np.maximum(0, half * HALF - HALF // 2), half * HALF + 2 * HALF + HALF // 2


def _vector(terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, count = np.unique(terms, return_counts=True)
    return distinct, count * idf[distinct]


def common_words(words: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Length of the longest common subsequence, of all of ``words`` and of their last quarter.

    Bit-parallel: one integer has a bit for each of ``words``.
    """
    answer = words[-max(1, len(words) // 4) :]
    out = []
    for sought in (words, answer):
        masks: dict[int, int] = {}
        for k, w in enumerate(sought.tolist()):
            masks[w] = masks.get(w, 0) | 1 << k
        full = (1 << len(sought)) - 1
        row = full
        for w in region.tolist():
            match = masks.get(w)
            if match:
                kept = row & match
                row = ((row + kept) | (row - kept)) & full
        out.append(len(sought) - row.bit_count())
    return out[0], out[1]


def longest_run(words: np.ndarray, region: np.ndarray) -> int:
    """Most words that stand in both without a gap."""
    places: dict[int, list[int]] = {}
    for k, w in enumerate(words.tolist()):
        places.setdefault(w, []).append(k)
    most, before = 0, {}
    for w in region.tolist():
        before = {k: before.get(k - 1, 0) + 1 for k in places.get(w, ())}
        most = max(most, max(before.values(), default=0))
    return most


def _frequencies(docs: DataFrame, text: str, shared) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = shared.value, 0
        size = len(block.terms)
        seen = np.zeros(size + 1, np.int64)
        for batch in parts(batches):
            texts = batch.column(0).to_pylist()
            seen[size] += len(texts)
            for begin, end in slices(texts):
                hashes, bounds = _hashed(texts[begin:end])
                place, term = block.hits(hashes)
                owner = np.searchsorted(bounds, place, "right") - 1
                seen[:size] += np.bincount(np.unique(owner * size + term) % max(1, size), minlength=size)
            total += 1
        if total:
            met = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[met])], ["term", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    sums = rows.mapInArrow(tidy(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(shared.value.terms) + 1, np.int64)
    for r in sums:
        out[r["term"]] = r["n"]
    return int(out[-1]), out[:-1]


def _times_gram(passages: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """A'(A matrix) for the stored rows of A; partial sums are added where the shuffle brings a term together."""
    context = passages.sparkSession.sparkContext
    shared = context.broadcast(matrix)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = shared.value
        out, met = np.zeros_like(right), np.zeros(len(right), bool)
        for batch in batches:
            for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                weights = np.array(weights)
                out[terms] += weights[:, None] * (weights @ right[terms])
                met[terms] = True
        rows = np.flatnonzero(met)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(out[rows]), pa.list_(pa.float64()))], ["term", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            total = np.sum(group.column("row").to_pylist(), axis=0)
            yield pa.RecordBatch.from_arrays([group.column("term").chunk(0).slice(0, 1), pa.array([total], pa.list_(pa.float64()))], ["term", "row"])

    kind = "term long, row array<double>"
    sums = passages.select("terms", "weights").mapInArrow(tidy(multiply), kind).repartition("term").sortWithinPartitions("term").mapInArrow(tidy(add), kind)
    out = np.zeros_like(matrix)
    for r in sums.collect():
        out[r["term"]] = r["row"]
    shared.destroy()
    return out


def latent_basis(passages: DataFrame, terms: int) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the passages by randomised subspace iteration."""
    width = min(terms, RANK + OVERSAMPLING)
    basis = np.linalg.qr(np.random.default_rng(3).normal(size=(terms, width)))[0]
    for _ in range(POWERS):
        basis = np.linalg.qr(_times_gram(passages, basis))[0]
    small = basis.T @ _times_gram(passages, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][: min(RANK, terms)]
    return (basis @ vectors[:, order]).astype(np.float32)


def _fitted(docs: DataFrame, doc_id: str, text: str, items: list[tuple[object, str]]) -> Block:
    spark: SparkSession = docs.sparkSession
    block = Block(items)
    if not block.words:
        return block.prepare()
    counting = spark.sparkContext.broadcast(block)
    block.weigh(*_frequencies(docs, text, counting))
    counting.destroy()
    own = [(a.tolist(), (w / max(1e-9, np.linalg.norm(w))).tolist()) for a, w in block.passages() if len(a)]
    matrix = spark.createDataFrame(own, "terms array<long>, weights array<double>")
    block.basis = latent_basis(matrix, len(block.terms))
    return block.prepare()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains: doc_id, item_id, cosine, common_share, answer_share, passage, passage_share.

    common_share is the part of the item's words that the document has in the same order near one
    place (each passage's within 3 * HALF words, with LEAST_WEIGHT of its weight: what is spread wider is not found), answer_share that of the item's last quarter. Of items longer than PASSAGE words one passage is
    enough: passage is the place of the best one's first word in the item, passage_share its share. Words are runs of letters and digits
    in lower case. Null and empty texts contain nothing and null or wordless items are contained
    nowhere; a repeated document row, or item, gives its pairs again. Other columns are not read.
    """
    spark = docs.sparkSession
    python_ready(spark)
    queries = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-queries.count() // ITEMS))
    kind_doc, kind_item = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    found = None
    for k in range(blocks):
        items = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = _fitted(docs, doc_id, text, [(r["item_id"], r["text"]) for r in items])
        shared = spark.sparkContext.broadcast(block)

        def search(texts: list[str], shared=shared) -> list[list]:
            block: Block = shared.value
            out: list[list[dict]] = [[] for _ in texts]
            if block.words:
                for t, item, cosine, common, answer, passage, part in block.search(texts):
                    out[t].append({"item_id": item, "cosine": cosine, "common_share": common, "answer_share": answer, "passage": passage, "passage_share": part})
            return [pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common_share", pa.float64()), ("answer_share", pa.float64()), ("passage", pa.int64()), ("passage_share", pa.float64())])))]

        hits = map_texts(docs, doc_id, text, {"hits": "array<struct<item_id:long,cosine:double,common_share:double,answer_share:double,passage:long,passage_share:double>>"}, search)
        names = spark.createDataFrame(
            [(k, i) for k, i in enumerate(block.items)], f"number long, item_id {kind_item}"
        )
        each = hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", F.col("h.item_id").alias("number"), "h.cosine", "h.common_share", "h.answer_share", "h.passage", "h.passage_share")
        each = stored(each.join(F.broadcast(names), "number").select("doc_id", "item_id", "cosine", "common_share", "answer_share", "passage", "passage_share"), "hits")
        shared.destroy()
        found = each if found is None else found.unionByName(each)
    return found.select(F.col("doc_id").cast(kind_doc), "item_id", "cosine", "common_share", "answer_share", "passage", "passage_share")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns.

    Each row is judged by its own text, also where ids are null or repeat with other texts.
    """
    own = row_key(docs, doc_id, text)
    keyed = docs.select(own.alias("doc_id"), F.col(text).alias("text"))
    found = contaminated(keyed, benchmark).select(F.col("doc_id.id").alias("_found_id"), F.col("doc_id.mark").alias("_found_mark")).distinct()
    same = docs[doc_id].eqNullSafe(found["_found_id"]) & (own["mark"] == found["_found_mark"])
    return docs.join(found, same, "left_anti")
