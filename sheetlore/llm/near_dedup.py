"""Near-duplicate detection with SetSketch registers.

Each document's set of word shingles is summarised by m registers, truncated integers on an
exponential scale of the minimum of m hash functions over the set. Registers of a union are the
maxima of the registers, and two sets agree in a register about as often as their Jaccard similarity.
Bands of registers find candidates, the joint likelihood of how two sketches compare weeds them out,
and the full sets decide.

Documents with the same set are one class from the start. In each band's bucket classes are first
linked to few others (stars), which are verified; where a bucket still holds several components,
every pair across them that the likelihood admits is verified too, so no link between components is
lost to a cap. Large buckets are dealt out in blocks; beyond the first round only classes outside
the bucket's largest component travel to every block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlore.llm.common import map_texts, mix, parts, python_ready, row_key, slices, sorted_groups, stored, tidy, unused, word_hashes

ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Least likelihood estimate of a candidate: nearly four standard errors below the threshold of 0.8.
ADMITTED = 0.68
#: Classes of one bucket that a task compares.
BLOCK = 8192
#: Classes outside the largest component that a verifying task handles.
CHUNK = 256

_DRAW = np.random.default_rng(7)
_LOW = _DRAW.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_HIGH = _DRAW.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a shorter text is one shingle, one without words none."""
    hashes, bounds = word_hashes(texts)
    joined = hashes.copy()
    for k in range(1, words):
        shifted = np.zeros_like(hashes)
        shifted[: len(hashes) - k] = hashes[k:]
        joined = mix(joined * np.uint64(0xD6E8FEB86659FD93)) + shifted
    joined = mix(joined)
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= words:
            out.append(np.unique(joined[begin : end - words + 1]))
        elif end > begin:
            whole = hashlib.blake2b(hashes[begin:end].tobytes(), digest_size=8, salt=b"short").digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set: floor(1 - log_b of the least of exponential values), truncated."""
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 1024):
        values = _LOW[:, None] * low[None, k : k + 1024]
        values += _HIGH[:, None] * high[None, k : k + 1024]
        np.minimum(least, values.min(axis=1), out=least)
    waiting = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(waiting) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-12)) / np.log(BASE)


_GRID = np.linspace(0.5, 1.0, 101)


def likeliest(above: np.ndarray, equal: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity (from 0.5 on) of greatest likelihood, from how many registers of the first
    set exceed and equal the second's and from both set sizes."""
    share = (size / (size + sizes))[:, None]
    most = np.minimum(share, 1 - share) / np.maximum(share, 1 - share)
    grid = np.minimum(_GRID[None, :], most)
    more = np.clip(_chance(share - (1 - share) * grid), 1e-9, 1)
    fewer = np.clip(_chance((1 - share) - share * grid), 1e-9, 1)
    same = np.clip(1 - more - fewer, 1e-9, 1)
    below = REGISTERS - above - equal
    score = above[:, None] * np.log(more) + below[:, None] * np.log(fewer) + equal[:, None] * np.log(same)
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def admitted(one: int, others: np.ndarray, sketches: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``others`` whose similarity to ``one`` may reach the threshold, and the estimates."""
    near = others[(np.minimum(sizes[others], sizes[one]) * 100 >= 80 * np.maximum(sizes[others], sizes[one]))]
    equal = (sketches[near] == sketches[one]).sum(axis=1)
    keep = equal >= 0.53 * REGISTERS
    near, equal = near[keep], equal[keep]
    if not len(near):
        return near, np.zeros(0)
    above = (sketches[one] > sketches[near]).sum(axis=1)
    estimate = likeliest(above, equal, np.full(len(near), float(sizes[one])), sizes[near].astype(float))
    keep = estimate >= ADMITTED
    return near[keep], estimate[keep]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union of two sorted sets."""
    common = len(a) + len(b) - len(np.union1d(a, b)) if min(len(a), len(b)) else 0
    return 100 * common >= 80 * (len(a) + len(b) - common) and common > 0


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: each class with the first centre that may be its neighbour; centres are taken in order."""
    for group in sorted_groups(batches):
        ids, sizes, sketches = np.asarray(group.column("cid")), np.asarray(group.column("n")), _matrix(group.column("sketch"))
        open_, left, right = np.arange(len(ids)), [], []
        while len(open_) > 1:
            found, _ = admitted(int(open_[0]), open_[1:], sketches, sizes)
            left += [int(ids[open_[0]])] * len(found)
            right += ids[found].tolist()
            open_ = np.setdiff1d(open_[1:], found, assume_unique=True)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket's block: the classes of pairs across components that may be linked.

    Rows are (unit, band, cid, asks): what a later task needs together, a class once per unit; those
    that ask are outside the largest component and at most CHUNK a unit.
    """
    for group in sorted_groups(batches):
        bucket = _Bucket(group)
        for number, some in enumerate(np.array_split(bucket.asking, max(1, -(-len(bucket.asking) // CHUNK)))):
            wanted: set[int] = set()
            asks = []
            for one in some.tolist():
                found = bucket.partners(one, bucket.component)
                if len(found):
                    asks.append(one)
                    wanted.update(found.tolist())
            rest = sorted(wanted.difference(asks))
            if asks:
                n = len(asks) + len(rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{bucket.unit}/{number}"] * n), pa.array([bucket.band] * n, pa.int32()), pa.array(bucket.ids[asks + rest]),
                     pa.array([True] * len(asks) + [False] * len(rest))],
                    ["unit", "band", "cid", "asks"],
                )


class _Bucket:
    """Classes of a bucket's block, or of a unit of it, with what decides which pairs to compare."""

    def __init__(self, group: pa.Table):
        self.ids, self.sizes, self.sketches = np.asarray(group.column("cid")), np.asarray(group.column("n")), _matrix(group.column("sketch"))
        self.component, self.minor = np.asarray(group.column("component")), np.asarray(group.column("minor"))
        self.home, self.block = np.asarray(group.column("home")), int(group.column("block")[0].as_py())
        self.band, self.unit = int(group.column("band")[0].as_py()), group.column("unit")[0].as_py()
        self.asking = np.flatnonzero(self.minor)
        self.bands = self.sketches.reshape(len(self.ids), BANDS, ROWS)

    def partners(self, one: int, component: np.ndarray) -> np.ndarray:
        """Classes of other components that may be linked to ``one``, likeliest first.

        A pair is taken up where it agrees first among the bands, once within a bucket; of two
        visitors to a block, their own blocks take care.
        """
        other = (component != component[one]) & ((~self.minor) | (self.ids > self.ids[one]))
        other &= (self.home == self.block) | (self.home[one] == self.block)
        found, estimate = admitted(one, np.flatnonzero(other), self.sketches, self.sizes)
        first = (self.bands[found] == self.bands[one]).all(axis=2).argmax(axis=1) == self.band
        return found[first][np.argsort(-estimate[first], kind="stable")]


def _verify_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components, confirmed on full sets; what is connected by then is not compared."""
    for group in sorted_groups(batches):
        bucket = _Bucket(group)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
        component, left, right = bucket.component.copy(), [], []
        for one in np.flatnonzero(np.asarray(group.column("asks"))).tolist():
            for other in bucket.partners(one, component).tolist():
                if component[one] != component[other] and linked(sets[one], sets[other]):
                    component[component == component[other]] = component[one]
                    left.append(int(bucket.ids[one]))
                    right.append(int(bucket.ids[other]))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 64):  # rows hold two whole sets
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("set_a", "set_b")]
        right = pa.array([linked(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(right), batch.column("b").filter(right)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(cid, component): the smallest id reachable over ``edges`` (a, b), for ids that have edges.

    Labels take the least label of all neighbours, then the label of their label, until nothing
    changes. Each round is stored, so that its plan stays short and survives lost executors.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        least = stored(
            labels.join(heard, "a").select("a", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "labels"
        )
        jumped = least.select(F.col("a").alias("label"), F.col("label").alias("further"))
        labels = stored(least.join(jumped, "label", "left").select("a", "old", F.least("label", "further").alias("label")), "labels")
        if labels.filter("label < old").isEmpty():
            return labels.select(F.col("a").alias("cid"), F.col("label").alias("component"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(row_key(docs, doc_id, text).alias("key"), docs[text].alias("text"))


def _sketches(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    def sketch(texts: list[str]) -> list[list]:
        sizes, digests, sketches = [], [], []
        for begin, end in slices(texts):
            for found in shingle_sets(texts[begin:end], words):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketches.append(registers(found).tobytes() if len(found) else None)
        return [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]

    found = map_texts(_keyed(docs, doc_id, text), "key", "text", {"n": "long", "digest": "binary", "sketch": "binary"}, sketch)
    return stored(found.select(F.col("doc_id.id").alias("id"), F.col("doc_id.mark").alias("mark"), "n", "digest", "sketch"), "sketches")


def _sets_of(docs: DataFrame, doc_id: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(cid, shingles) of the wanted classes (cid, rep, digest), from one row of each."""

    def sets(texts: list[str]) -> list[list]:
        digests, found = [], []
        for begin, end in slices(texts):
            for each in shingle_sets(texts[begin:end], words):
                digests.append(hashlib.blake2b(each.tobytes(), digest_size=16).digest())
                found.append(each.tobytes())
        return [pa.array(digests, pa.binary()), pa.array(found, pa.binary())]

    rows = _keyed(docs, doc_id, text)
    asked = wanted.select(F.col("rep.id").alias("rep_id"), F.col("rep.mark").alias("rep_mark")).distinct()
    chosen = rows.join(asked, rows["key.id"].eqNullSafe(asked["rep_id"]) & (rows["key.mark"] == asked["rep_mark"]), "left_semi")
    computed = map_texts(chosen, "key", "text", {"digest": "binary", "shingles": "binary"}, sets)
    same = computed.select("digest", "shingles").join(wanted.select("cid", "digest"), "digest")
    return stored(same.groupBy("cid").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def _groups(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """id, mark, n and the representative (struct of missing, id, mark) of every row's group.

    Rows are known by id and a hash of the text, so that null and repeated ids lose no link. The
    representative has the smallest id, null last, then the smallest hash.
    """
    spark = docs.sparkSession
    python_ready(spark)
    sketches = _sketches(docs, doc_id, text, words)
    classes = stored(
        sketches.filter("digest IS NOT NULL").groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "mark")).alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    banded = classes.select("cid", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sketch"), k * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    )).alias("band", "bucket"))
    crowded = banded.groupBy("band", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(banded.join(crowded, ["band", "bucket"]), "members")
    traits = classes.select("cid", "n", "sketch")

    # First round: stars inside blocks, all blocks of a bucket with its first class.
    block = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / BLOCK)).cast("int")
    placed = members.withColumn("block", block)
    leaders = members.filter(F.col("size") > BLOCK).groupBy("band", "bucket", "size").agg(F.min("cid").alias("cid")).select(
        "band", "bucket", "cid", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)).alias("block")
    )
    unit = F.concat_ws("/", "band", "bucket", "block")
    first = placed.unionByName(leaders).distinct().join(traits, "cid").select(unit.alias("unit"), "cid", "n", "sketch")
    stars = first.repartition("unit").sortWithinPartitions("unit", "cid").mapInArrow(tidy(_stars), "a long, b long")
    pairs = stored(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star-pairs")
    named = classes.select("cid", "rep", "digest")
    asked = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = _sets_of(docs, doc_id, text, words, named.join(asked, "cid"))
    with_sets = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b")), "b").join(
        sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a")), "a"
    )
    links = stored(with_sets.mapInArrow(tidy(_verify_pairs), "a long, b long"), "star-links")
    reached = components(links)

    # Second round: buckets that hold several components.
    labelled = stored(members.join(reached, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "labelled")
    shares = labelled.groupBy("band", "bucket", "component").agg(F.count("*").alias("own"))
    mixed = shares.groupBy("band", "bucket").agg(F.max(F.struct("own", "component"))["component"].alias("major"), F.count("*").alias("parts"))
    mixed = mixed.filter("parts > 1").drop("parts")
    several = labelled.join(mixed, ["band", "bucket"]).withColumn("minor", F.col("component") != F.col("major")).withColumn("home", block)
    everywhere = F.sequence(F.lit(0), F.ceil(F.col("size") / BLOCK).cast("int") - 1)
    dealt = several.withColumn("block", F.explode(F.when(F.col("minor"), everywhere).otherwise(F.array("home"))))
    second = dealt.join(traits, "cid").select(unit.alias("unit"), "cid", "n", "sketch", "component", "minor", "home", "band", "block")
    units = stored(
        second.repartition("unit").sortWithinPartitions("unit", "cid").mapInArrow(tidy(_across), "unit string, band int, cid long, asks boolean"), "units"
    )
    more = units.select("cid").distinct().join(sets, "cid", "left_anti")
    every_set = sets.unionByName(_sets_of(docs, doc_id, text, words, named.join(more, "cid")))
    places = several.select("band", "bucket", "cid", "component", "minor", "home")
    own_block = F.split("unit", "/")
    full = (
        units.withColumn("bucket", own_block[1].cast("long")).withColumn("block", own_block[2].cast("int"))
        .join(places, ["band", "bucket", "cid"]).join(traits, "cid").join(every_set, "cid")
        .select("unit", "cid", "n", "sketch", "component", "minor", "home", "band", "block", "asks", "shingles")
    )
    crossing = full.repartition("unit").sortWithinPartitions("unit", "cid").mapInArrow(tidy(_verify_units), "a long, b long")
    all_links = stored(links.unionByName(crossing), "all-links")
    final = components(all_links)

    roots = final.join(classes.select("cid", "rep"), "cid").groupBy("component").agg(F.min("rep").alias("head"))
    grouped = final.join(roots, "component").select("cid", "head")
    by_class = stored(classes.select("cid", "rep", "digest").join(grouped, "cid", "left").select("digest", F.coalesce("head", "rep").alias("head")), "class-groups")
    alone = F.struct(F.col("id").isNull().alias("missing"), "id", "mark")
    return sketches.select("id", "mark", "n", "digest").join(by_class, "digest", "left").select("id", "mark", "n", F.coalesce("head", alone).alias("head"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """Every row with its group of near-duplicates.

    Returns doc_id, n_shingles, component_id, kept. Two documents are linked when their sets of
    ``words``-word shingles have a Jaccard similarity of at least 0.8; a group is what links reach,
    named by its smallest doc_id, which alone is kept. Words are runs without ASCII white space after
    lower-casing A-Z; a text with fewer words is one shingle. Null, empty and blank texts have no
    shingles and stand alone. Rows that repeat an id form groups as their texts do, and all rows with
    the id that names their group are kept. A null id names a group only where all ids are null; of
    its different texts one is kept. Other columns are not read; an empty table gives an empty one.
    """
    own = F.when(F.col("id").isNull(), F.col("head.id").isNull() & (F.col("mark") == F.col("head.mark"))).otherwise(F.col("id").eqNullSafe(F.col("head.id")))
    return _groups(docs, doc_id, text, words).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("head.id").alias("component_id"), own.alias("kept")
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    Of rows that repeat both id and text any one may stay; texts without shingles all stay.
    """
    groups = _groups(docs, doc_id, text, words)
    heads = groups.filter(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("mark") == F.col("head.mark")))
    kept = stored(heads.groupBy("id", "mark").agg(F.max("n").alias("n"), F.count("*").alias("rows")), "kept-rows")
    own = row_key(docs, doc_id, text)
    same = docs[doc_id].eqNullSafe(kept["id"]) & (own["mark"] == kept["mark"])
    if kept.filter("n > 0 AND rows > 1").isEmpty():
        return docs.join(kept, same, "left_semi")
    names = {c: unused(docs, c) for c in ("_mark", "_row")}
    marked = docs.withColumns({names["_mark"]: own["mark"], names["_row"]: F.monotonically_increasing_id()})
    several = kept.select(F.col("id").alias("_kept_id"), F.col("mark").alias("_kept_mark"), ((F.col("n") > 0) & (F.col("rows") > 1)).alias("_kept_several"))
    joined = marked.join(several, marked[doc_id].eqNullSafe(several["_kept_id"]) & (marked[names["_mark"]] == several["_kept_mark"]))
    once = joined.withColumn(names["_row"], F.when(F.col("_kept_several"), F.lit(0)).otherwise(F.col(names["_row"])))
    return once.dropDuplicates([doc_id, names["_mark"], names["_row"]]).select(*docs.columns)
