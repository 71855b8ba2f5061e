"""Removal of repeated passages by a multi-document suffix order, built column by column.

Of every string of ``LENGTH`` bytes (a window) the first occurrence stays. Windows are grouped by their
anchor, the ANCHOR-byte string in them that hashes lowest, so equal windows have equal anchors. A piece
is a run of windows with one anchor occurrence, at most 2 * LENGTH - ANCHOR bytes. Equal pieces are
merged where they are found and after the shuffle, the first one stays; only pieces that share an anchor
with different ones are compared further.

Those are the documents of a collection whose Burrows-Wheeler transform and common prefixes grow by
columns: each round takes one more symbol of every piece, from its end on, finds the places of the new
suffixes from the transform by counting (last-to-first), and merges them in by one sequential pass,
updating the common prefixes of the new rows and of those that follow them. The rows of a finished
collection lie in suffix order, so equal windows are runs of rows with common prefixes of at least
LENGTH. Collections are bounded, their rounds by the length of a piece.

Positions of repeated windows go back to the documents, whose bytes are cut there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlore.llm.common import mix, parts, python_ready, stored

#: Bytes of a string whose repetitions are removed.
LENGTH = 100
#: Bytes of an anchor; a window has LENGTH - ANCHOR + 1 places for it.
ANCHOR = 40
#: Bytes of text that are hashed together.
STRETCH = 1 << 16
#: Pieces merged before they are sent on.
HELD_PIECES = 400_000
#: Anchors whose pieces are cut into single windows from the start, because they are the most frequent ones.
HOT_ANCHORS = 4096
#: Different pieces with one anchor that meet in a collection; of a fuller anchor, windows meet by their own hashes.
FULL = 20_000
#: Bytes of a collection.
COLLECTION = 200_000

_PLACES = LENGTH - ANCHOR + 1
_LOW = 18
assert STRETCH + 2 * LENGTH < 1 << _LOW
_RNG = np.random.default_rng(20240913)
_SYMBOL = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SIZE = STRETCH + 2 * LENGTH + 1
_POWER = np.cumprod(np.concatenate(([np.uint64(1)], np.full(_SIZE, np.uint64(_BASE)))))
_ROW = (1 << 32) - 1
_PLACE_BITS, _AT = np.uint64((1 << _LOW) - 1), np.arange(_SIZE, dtype=np.uint64)
_INVERSE = np.cumprod(np.concatenate(([np.uint64(1)], np.full(_SIZE, np.uint64(pow(_BASE, -1, 2**64))))))


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * _POWER[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, begin: np.ndarray, length) -> np.ndarray:
    """Hashes of the strings of given lengths at given places, the same wherever they stand."""
    return mix((sums[begin + length] - sums[begin]) * _INVERSE[begin] + np.asarray(length, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces_of(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, start in it, windows, anchor, name) of all pieces of documents laid end to end.

    ``bounds`` has where each document begins, and the end. Anchor and name are hashes of the anchor's
    and of the piece's bytes. Every window is whole in one stretch; where two stretches meet, a run of
    windows may become two pieces with the same anchor.
    """
    begin, last = 0, len(data) - LENGTH + 1  # the first window not yet taken, windows in all
    while begin < last:
        end = min(last, begin + STRETCH)
        part = data[begin : end + LENGTH - 1]
        yield from _stretch_pieces(part, begin, bounds)
        begin = end


def _stretch_pieces(part: np.ndarray, begin: int, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    windows = len(part) - LENGTH + 1
    # owner of each window, and whether it lies inside one document
    low, high = np.searchsorted(bounds, (begin, begin + windows - 1), "right") - 1
    owner = np.repeat(np.arange(low, high + 1), np.diff(np.clip(bounds[low : high + 2] - begin, 0, windows)))
    inside = np.arange(begin + LENGTH, begin + LENGTH + windows) <= bounds[owner + 1]
    if not inside.any():
        return
    sums = _prefix_hashes(part)
    count = len(part) - ANCHOR + 1
    anchors = sums[ANCHOR:] - sums[:-ANCHOR]
    anchors *= _INVERSE[:count]
    anchors ^= anchors >> np.uint64(29)
    anchors *= np.uint64(0x94D049BB133111EB)
    anchors ^= anchors >> np.uint64(32)
    least = anchors & ~_PLACE_BITS
    least |= _AT[:count]  # of equal anchors the first
    width = 1
    while width * 2 <= _PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _PLACES:
        least = np.minimum(least[: width - _PLACES], least[_PLACES - width :])
    least &= _PLACE_BITS
    where = least.view(np.int64)
    # An anchor's place belongs to one document only; windows across two documents belong to none.
    edge = np.flatnonzero((where[1:] != where[:-1]) | (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1])) + 1
    first = np.concatenate(([0], edge))
    count = np.diff(np.concatenate((first, [windows])))
    keep = inside[first]
    first, count = first[keep], count[keep]
    yield owner[first], begin + first - bounds[owner[first]], count, anchors[where[first]], _hash(sums, first, count + (LENGTH - 1))


def single_windows(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(route, name) of each window of a piece: two hashes, so that windows are alike only if both are."""
    sums = _prefix_hashes(np.frombuffer(piece, np.uint8))
    at = np.arange(len(piece) - LENGTH + 1)
    halves = [_hash(sums, at + k, LENGTH // 2) for k in (0, LENGTH - LENGTH // 2)]
    return mix(halves[0] * np.uint64(0xA24BAED4963EE407) + halves[1]), _hash(sums, at, LENGTH)


# --- the collection ------------------------------------------------------------------------------


class Collection:
    """Burrows-Wheeler transform, common prefixes and suffix places of some strings, grown by columns.

    Symbols are bytes plus one; 0 is the end of a string. Rows are in suffix order: ``lcp`` has the symbols
    that a suffix shares with the row above, ``start`` where it begins in the concatenated strings. The
    transform is kept by symbols: ``keys`` are the pairs of the symbol before a suffix and its row, sorted,
    which is the order of those longer suffixes.
    """

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.text = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.first = np.zeros(len(self.text) + 1, bool)
        self.first[self.begins] = True
        self.start = self.ends.astype(np.int32)
        self.lcp = np.zeros(len(strings), np.uint8)
        # an empty suffix stands where the next string begins, so strings must not be empty
        self.keys = np.sort(self.text[self.ends - 1].astype(np.int64) << 32 | np.arange(len(strings)))
        self.rank = np.arange(len(strings))  # among the keys: the rows of the last column, as long as their strings go on

    @property
    def bwt(self) -> np.ndarray:
        out = np.empty(len(self.keys), np.uint8)
        out[self.keys & _ROW] = self.keys >> 32
        return out

    def build(self) -> Collection:
        while len(self.rank):
            self.insert_column()
        return self

    def insert_column(self) -> None:
        """One more symbol of every string that has one: its suffix's row is merged in."""
        keys, rank = self.keys, self.rank
        rows, symbol = keys[rank] & _ROW, keys[rank] >> 32
        target = len(self.ends) + rank - np.searchsorted(keys, 1 << 32)  # empty suffixes come first; ended strings go nowhere
        above, below = keys[np.maximum(rank - 1, 0)], keys[np.minimum(rank + 1, len(keys) - 1)]
        same_above, same_below = (rank > 0) & (above >> 32 == symbol), (rank + 1 < len(keys)) & (below >> 32 == symbol)
        least = _RangeMinimum(self.lcp)
        lcp = np.zeros(len(rows), np.uint8)
        lcp[same_above] = np.minimum(least((above[same_above] & _ROW) + 1, rows[same_above]), 254) + 1
        follow = np.minimum(least(rows[same_below] + 1, below[same_below] & _ROW), 254) + 1

        start = self.start[rows] - 1
        before = np.where(self.first[start], np.uint8(0), self.text[start - 1])
        at = target - np.arange(len(target))  # the rows above which the new ones go
        shift = np.cumsum(np.bincount(at, minlength=len(keys) + 1))
        keys = keys + shift[keys & _ROW]
        new = np.sort(before.astype(np.int64) << 32 | target)
        place = np.searchsorted(keys, new)
        self.keys = np.insert(keys, place, new)
        self.rank = (place + np.arange(len(new)))[new >> 32 > 0]
        self.lcp, self.start = np.insert(self.lcp, at, lcp), np.insert(self.start, at, start)
        self.lcp[target[same_below] + 1] = follow


class _RangeMinimum:
    """Least values of ranges, by tables of ranges whose lengths are powers of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]

    def __call__(self, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros(0, np.uint8)
        level = np.frexp((last - begin + 1).astype(np.float64))[1] - 1
        while len(self.tables) <= int(level.max()):
            half = 1 << (len(self.tables) - 1)
            above = self.tables[-1]
            self.tables.append(np.minimum(above[:-half], above[half:]))
        out = np.empty(len(begin), np.uint8)
        for k in np.unique(level):
            mine = level == k
            table = self.tables[k]
            out[mine] = np.minimum(table[begin[mine]], table[last[mine] - (1 << int(k)) + 1])
        return out


def repeated_windows(strings: list[bytes], order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of the windows of these pieces that occur earlier in another of them.

    A piece stands in the ``order``-th document from ``start`` on; earlier is a smaller pair of both.
    """
    built = Collection(strings).build()
    # equal windows: consecutive rows, all of whose common prefixes reach LENGTH
    group = np.cumsum(built.lcp < LENGTH) - 1
    chosen = np.flatnonzero((np.bincount(group) > 1)[group])
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, group = built.start[chosen].astype(np.int64), group[chosen]
    owner = np.searchsorted(built.ends, at, "right")
    window = at - built.begins[owner]
    place = np.lexsort((start[owner] + window, order[owner], group))
    owner, window, group = owner[place], window[place], group[place]
    key = (order[owner], start[owner] + window)
    new = np.concatenate(([True], group[1:] != group[:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (key[0] != key[0][head]) | (key[1] != key[1][head])
    return owner[later], window[later]


# --- Spark ---------------------------------------------------------------------------------------

_COLUMNS = ["doc_id", "mark", "route", "name", "begin", "windows", "kind"]
#: Kinds of rows: first occurrences; windows that are repeated; first occurrences that share an anchor with others.
FIRST, HIT, MIXED = 0, 1, 2


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, mark, text: rows that repeat an id are told apart by a hash of their texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))


def _laid_out(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, bounds) of texts laid end to end, about STRETCH bytes at a time; a longer text stands alone."""
    begin, held, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > STRETCH:
            yield begin, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            begin, held, size = k, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield begin, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


class _Held:
    """Pieces of some documents: ids, marks, columns (document, start, windows, anchor, name), and the bytes of hot pieces."""

    def __init__(self, hot: np.ndarray):
        self.hot, self.ids, self.marks, self.found, self.size, self.rows = hot, [], [], [], 0, 0
        self.bytes: dict[int, bytes] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids.append(batch.column(0))
        self.marks.append(batch.column(1))
        for first, data, bounds in _laid_out(batch.column(2).to_pylist()):
            for owner, start, windows, anchor, name in pieces_of(data, bounds):
                if len(self.hot):
                    for k in np.flatnonzero(np.isin(anchor, self.hot)).tolist():
                        if int(name[k]) not in self.bytes:
                            begin = int(bounds[owner[k]] + start[k])
                            self.bytes[int(name[k])] = data[begin : begin + int(windows[k]) + LENGTH - 1].tobytes()
                self.found.append((owner + first + self.rows, start, windows, anchor, name))
                self.size += len(owner)
        self.rows += batch.num_rows

    def columns(self) -> tuple[pa.Array, pa.Array, list[np.ndarray]]:
        return pa.concat_arrays(self.ids), pa.concat_arrays(self.marks), [np.concatenate(c) for c in zip(*self.found, strict=True)]


def _held(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[_Held]:
    held = _Held(hot)
    for batch in parts(batches):
        held.add(batch)
        if held.size >= HELD_PIECES:
            yield held
            held = _Held(hot)
    if held.size:
        yield held


def _order(ids: pa.Array, marks: pa.Array) -> np.ndarray:
    """Places of documents by id (null first) and mark; equal ones share a place."""
    coded = ids.dictionary_encode()
    rank = np.zeros(len(coded.dictionary) + 1, np.int64)
    rank[np.asarray(pc.sort_indices(coded.dictionary)) + 1] = np.arange(1, len(coded.dictionary) + 1)
    name = rank[np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64) + 1]
    mark = np.asarray(marks)
    by = np.lexsort((mark, name))
    new = np.concatenate(([False], (name[by][1:] != name[by][:-1]) | (mark[by][1:] != mark[by][:-1]))) if len(by) else np.zeros(0, bool)
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with many different pieces among the documents held together."""
    for held in _held(batches, np.zeros(0, np.uint64)):
        _, _, _, anchor, name = held.columns()[2]
        by = np.lexsort((name, anchor))
        anchor, name = anchor[by], name[by]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1])))
        anchor = anchor[new]
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.concatenate((first, [len(anchor)])))
        many = np.argsort(-size, kind="stable")[:HOT_ANCHORS]
        many = many[size[many] >= 16]
        yield pa.RecordBatch.from_arrays([pa.array(_as_long(anchor[first[many]])), pa.array(size[many])], ["route", "n"])


def _first_and_later(order: np.ndarray, start: np.ndarray, route: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first of all with their route and name, and rows elsewhere than these."""
    by = np.lexsort((start, order, name, route))
    route, name, order, start = (x[by] for x in (route, name, order, start))
    new = np.concatenate(([True], (route[1:] != route[:-1]) | (name[1:] != name[:-1]))) if len(by) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(by) else by
    return by[new], by[~new & ((order != order[head]) | (start != start[head]))]


def _send(hot: np.ndarray):
    """First pieces of the documents held together, and where the documents repeat them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, hot):
            ids, marks, (owner, start, windows, anchor, name) = held.columns()
            order = _order(ids, marks)
            first, later = _first_and_later(order[owner], start, anchor, name)
            repeated = [(owner[later], start[later], windows[later])]
            is_hot = np.isin(anchor[first], hot)
            plain, cut = first[~is_hot], first[is_hot]
            yield _rows(ids, marks, owner[plain], anchor[plain], name[plain], start[plain], windows[plain], FIRST)
            if len(cut):
                found = [single_windows(held.bytes[int(name[k])]) for k in cut.tolist()]
                sizes = np.array([len(r) for r, _ in found])
                route, own = (np.concatenate(x) for x in zip(*found, strict=True))
                who = np.repeat(owner[cut], sizes)
                at = np.concatenate([int(start[k]) + np.arange(n) for k, n in zip(cut.tolist(), sizes.tolist(), strict=True)])
                one = np.ones(len(at), np.int64)
                first, later = _first_and_later(order[who], at, route, own)
                repeated.append((who[later], at[later], one[later]))
                yield _rows(ids, marks, who[first], route[first], own[first], at[first], one[first], FIRST)
            who, at, n = _touching(*(np.concatenate(x) for x in zip(*repeated, strict=True)))
            anywhere = mix(at.astype(np.uint64) + np.asarray(marks)[who].view(np.uint64))  # such rows meet nothing
            yield _rows(ids, marks, who, anywhere, np.zeros(len(who), np.uint64), at, n, HIT)

    return send


def _touching(owner: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one document that follow each other, as one."""
    by = np.lexsort((start, owner))
    owner, start, end = owner[by], start[by], (start + windows)[by]
    if not len(owner):
        return owner, start, end
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > end[:-1]))))
    return owner[first], start[first], np.maximum.reduceat(end, first) - start[first]


def _rows(ids, marks, owner, route, name, start, windows, kind: int) -> pa.RecordBatch:
    at = pa.array(owner, pa.int64())
    columns = [ids.take(at), marks.take(at), pa.array(_as_long(route)), pa.array(_as_long(name)), pa.array(start), pa.array(windows)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(owner), kind, np.int32))], _COLUMNS)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later occurrences of pieces (HIT), and the first ones of anchors that have several pieces (MIXED).

    Rows come sorted by route, name, doc_id, mark and begin. The last first occurrence of a batch waits
    for the next one's; nothing else is kept.
    """
    head: pa.RecordBatch | None = None  # the first occurrence that the next rows may repeat
    waiting, shared = None, False  # the last first occurrence, and whether the one before has its anchor
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([x for x in (head, batch) if x is not None]).combine_chunks()
        route, name = np.asarray(both.column("route")), np.asarray(both.column("name"))
        new = np.concatenate(([True], (route[1:] != route[:-1]) | (name[1:] != name[:-1])))
        heads = np.flatnonzero(new)[np.cumsum(new) - 1]
        mark, begin = np.asarray(both.column("mark")), np.asarray(both.column("begin"))
        coded = both.column("doc_id").combine_chunks().dictionary_encode()
        ids = np.asarray(pc.fill_null(coded.indices, -1))
        elsewhere = (ids != ids[heads]) | (mark != mark[heads]) | (begin != begin[heads])
        kind = np.asarray(both.column("kind"))
        skip = int(head is not None)
        hits = ((kind == HIT) | (~new & elsewhere)).astype(bool)
        hits[:skip] = False
        if hits.any():
            yield _of_kind(both.filter(pa.array(hits)), HIT)
        firsts = np.flatnonzero(new & (kind == FIRST))
        firsts = firsts[firsts >= skip]
        found = both.take(pa.array(firsts))
        if waiting is not None:
            found = pa.concat_tables([waiting, found])
        if found.num_rows:
            routes = np.asarray(found.column("route"))
            same = routes[1:] == routes[:-1]
            mixed = np.concatenate(([shared], same)) | np.concatenate((same, [False]))
            mixed[-1] = False
            if mixed.any():
                yield _of_kind(found.filter(pa.array(mixed)), MIXED)
            shared = bool(same[-1]) if len(same) else shared
            waiting = found.slice(found.num_rows - 1)
        head = both.slice(int(heads[-1]), 1).to_batches()[0]
    if waiting is not None and shared:
        yield _of_kind(waiting, MIXED)


def _of_kind(rows: pa.Table, kind: int) -> pa.RecordBatch:
    at = rows.schema.get_field_index("kind")
    return rows.set_column(at, "kind", pa.array(np.full(rows.num_rows, kind, np.int32))).combine_chunks().to_batches()[0]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted pieces; pieces of full anchors as single windows, by their hashes alone."""
    for batch in parts(batches, 256):
        out = []
        for k, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            raw = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                piece = raw[w["begin"] : w["begin"] + w["windows"] + LENGTH - 1]
                if w["full"]:
                    route, name = single_windows(piece)
                    out += [(k, r, n, w["begin"] + j, 1, None) for j, (r, n) in enumerate(zip(_as_long(route).tolist(), _as_long(name).tolist(), strict=True))]
                else:
                    out.append((k, w["route"], 0, w["begin"], w["windows"], piece))
        if out:
            at, route, name, begin, windows, piece = (list(x) for x in zip(*out, strict=True))
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in (route, name, begin, windows))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(out), FIRST, np.int32)), pa.array(piece, pa.binary())], [*_COLUMNS, "piece"])


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the pieces, whole anchors together, in collections of bounded size."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows:
            sizes = np.cumsum(np.asarray(held.column("windows")) + LENGTH - 1)
            if sizes[-1] < 2 * COLLECTION:
                break
            routes = np.asarray(held.column("route"))
            edges = np.flatnonzero(routes[1:] != routes[:-1]) + 1
            edges = edges[sizes[edges - 1] >= COLLECTION]
            if not len(edges):
                break  # one anchor, which has a bounded number of pieces
            yield from _collected(held.slice(0, int(edges[0])))
            held = held.slice(int(edges[0]))
    if held is not None and held.num_rows:
        yield from _collected(held)


def _collected(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    ids, marks = rows.column("doc_id").combine_chunks(), rows.column("mark").combine_chunks()
    start = np.asarray(rows.column("begin"))
    owner, window = repeated_windows(rows.column("piece").to_pylist(), _order(ids, marks), start)
    owner, window, n = _touching(owner, window, np.ones(len(owner), np.int64))
    if len(owner):
        zero = np.zeros(len(owner), np.uint64)
        yield _rows(ids, marks, owner, zero, zero, start[owner] + window, n, HIT)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the bytes of its repeated windows."""
    for batch in parts(batches):
        out = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for begin, end in sorted((r["begin"], r["begin"] + r["windows"] + LENGTH - 1) for r in ranges or ()):
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([begin, end])
            left, at = [], 0
            for begin, end in spans:
                left.append(raw[at:begin])
                at = end
            left.append(raw[at:])
            removed = sum(end - begin for begin, end in spans)
            kept = b"".join(left)
            out.append((len(raw), removed, len(spans), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in spans]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS)
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def hot_anchors(texts: DataFrame) -> np.ndarray:
    """The anchors, at most HOT_ANCHORS, with the most pieces; no other one has more than that share of all."""
    counted = texts.mapInArrow(_frequent, "route long, n long").groupBy("route").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "route").limit(HOT_ANCHORS).select("route").collect()
    return np.sort(np.array([r["route"] for r in top], np.int64).view(np.uint64))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with what is left of its text when bytes of repeated strings are removed.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin and end of each removed run).
    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a
    smaller id, or earlier in the same one; overlapping strings count, and all are judged on the whole
    input. Texts are UTF-8 bytes, null counts as empty, shorter texts lose nothing. Null ids come before
    all others; of rows that share an id those with different texts come in the order of a hash of the
    text, and rows that repeat id and text are one document and have the same result. Other columns are
    not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    python_ready(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, mark long, route long, name long, begin long, windows long, kind int"
    texts = _documents(docs, doc_id, text)
    long_enough = texts.filter(F.octet_length("text") >= LENGTH)
    sent = long_enough.mapInArrow(_send(hot_anchors(long_enough)), schema)
    place = ["route", "name", "doc_id", "mark", "begin"]
    settled = stored(sent.repartition("route").sortWithinPartitions(*place).mapInArrow(_settle, schema), "settled")

    mixed = settled.filter(F.col("kind") == MIXED)
    full = mixed.groupBy("route").agg(F.count("*").alias("n")).filter(F.col("n") > FULL).select("route", F.lit(True).alias("full"))
    wanted = (
        mixed.join(full, "route", "left")
        .groupBy("doc_id", "mark").agg(F.collect_list(F.struct("route", "begin", "windows", F.coalesce("full", F.lit(False)).alias("full"))).alias("wanted"))
    )
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])
    both = long_enough.join(wanted, same(long_enough, wanted)).select(long_enough["doc_id"], long_enough["mark"], "text", "wanted")
    pieces = stored(both.mapInArrow(_extract, schema + ", piece binary").dropDuplicates(["doc_id", "mark", "route", "begin", "windows"]), "pieces")
    by_order = pieces.filter("piece IS NOT NULL").repartition("route").sortWithinPartitions("route").mapInArrow(_collections, schema)
    by_hash = pieces.filter("piece IS NULL").drop("piece").repartition("route").sortWithinPartitions(*place).mapInArrow(_settle, schema)

    hits = settled.unionByName(by_order).unionByName(by_hash).filter(F.col("kind") == HIT)
    ranges = hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("begin", "windows")).alias("ranges"))
    found = texts.join(ranges, same(texts, ranges), "left").select(texts["doc_id"], "text", "ranges")
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>"
    return found.mapInArrow(_cut, out)
