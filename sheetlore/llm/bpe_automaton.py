"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts with one state that has an arc for every byte. Each merge (u, v) adds a gadget:
the state that u-arcs lead to is copied without the arc v, the u-arcs go to the copy, and wherever
there was a u-arc an arc uv is added that ends where v-arcs end. What it then accepts are exactly the
token sequences that the merges, applied by rank, produce. All arcs of one token end in one state, so
a state is named by the last token, and the arcs that a gadget denies (v and every token later built
upon it from the left) are one interval of a suitable numbering of the tokens. A word has one accepting
path; it is found by stepping through a table of token bytes and asking the state's row for the arc.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from sheetlore.llm.common import local_text, map_texts, python_ready

#: Fixed value: the pattern that splits a text into words before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words and their encodings that a task keeps.
CACHED_BYTES = 48_000_000
#: Characters of text handled together.
SLICE_CHARS = 1_000_000
_LONG_WORD = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def compile_automaton(vocabulary: str) -> dict:
    """Tables of the automaton from a vocabulary file's merges; plain arrays, fit for a broadcast."""
    spec = json.loads(local_text(vocabulary))
    model, added = spec["model"], spec.get("added_tokens", [])
    to_byte = {symbol: b for b, symbol in enumerate(byte_symbols())}
    ids = model["vocab"]
    labels = {i: bytes(to_byte[c] for c in token) for token, i in ids.items() if all(c in to_byte for c in token)}
    size = max(ids.values()) + 1
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    made = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
    if len({w for _, _, w in made}) != len(made):
        raise ValueError("two merges build the same token")

    # Number the tokens so that a token follows everything built on it from the left, the latest nearest.
    built: list[list[int]] = [[] for _ in range(size)]
    born = np.full(size, -1, np.int64)
    for rank, (u, _, w) in enumerate(made):
        built[u].append(w)
        born[w] = rank
    number, first = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count = 0
    stack = [(ids[symbol], False) for symbol in byte_symbols()[::-1]]
    while stack:
        token, closed = stack.pop()
        if closed:
            number[token] = count
            count += 1
        else:
            first[token] = count
            stack.append((token, True))
            stack.extend((child, False) for child in reversed(built[token]))

    # One gadget a merge. A state is its parent and one more denied interval; state 0 denies nothing.
    parent, low, high = [0], [0], [-1]
    state = np.zeros(size, np.int64)
    for rank, (u, v, w) in enumerate(made):
        state[w] = state[v]
        later = next((c for c in built[v] if born[c] >= rank), None)
        parent.append(int(state[u]))
        low.append(int(number[v] if later is None else first[later]))
        high.append(int(number[v]))
        state[u] = len(parent) - 1

    # Rows of denied arcs: sorted disjoint intervals, only for states that some token ends in.
    rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for s in sorted(set(state[sorted(labels)].tolist())):
        lows, highs, at = [], [], s
        while at:
            lows.append(low[at])
            highs.append(high[at])
            at = parent[at]
        a, b = np.array(lows, np.int64), np.array(highs, np.int64)
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
        fresh = np.concatenate(([True], a[1:] > b[:-1] + 1)) if len(a) else np.zeros(0, bool)
        ends = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(a) - 1])) if len(a) else np.zeros(0, np.int64)
        rows[s] = (a[fresh], b[ends.astype(np.int64)])
    row_of = {s: k for k, s in enumerate(rows)}
    stride = count + 1
    denied_low = np.concatenate([a + k * stride for k, (a, _) in enumerate(rows.values())])
    denied_high = np.concatenate([b + k * stride for k, (_, b) in enumerate(rows.values())])
    row = np.array([row_of[int(s)] if t in labels else 0 for t, s in enumerate(state)], np.int64)
    ordered = [labels.get(t, b"") for t in range(size)]
    special = [(t["content"], t["id"]) for t in added]
    tables = {"labels": ordered, "number": number, "row": row, "stride": stride, "low": denied_low, "high": denied_high, "special": special}
    return tables | _byte_steps(ordered)


def _byte_steps(labels: list[bytes]) -> dict[str, np.ndarray]:
    """Steps through the tokens' bytes: a row of 256 for each node that goes on, the first row for all others."""
    nodes: dict[bytes, int] = {b"": 0}
    for label in labels:
        for end in range(1, len(label) + 1):
            nodes.setdefault(label[:end], len(nodes))
    onward = {nodes[prefix[:-1]] for prefix in nodes if prefix}
    step_row = np.zeros(len(nodes), np.int32)
    step_row[sorted(onward)] = np.arange(1, len(onward) + 1)
    step, token = np.zeros((len(onward) + 1, 256), np.int32), np.full(len(nodes), -1, np.int32)
    for prefix, node in nodes.items():
        if prefix:
            step[step_row[nodes[prefix[:-1]]], prefix[-1]] = node
    for number, label in enumerate(labels):
        if label:
            token[nodes[label]] = number
    return {"step": step, "step_row": step_row, "token": token}


class Encoder:
    """Steps words through the automaton's tables; words seen before are remembered, up to a number of bytes."""

    def __init__(self, tables: dict):
        self.labels, self.special = list(tables["labels"]), tables["special"]
        self.number, self.row, self.stride = tables["number"], tables["row"], tables["stride"]
        self.low, self.high = tables["low"], tables["high"]
        self.lengths = np.array([len(x) for x in self.labels], np.int32)
        self.words = regex.compile(WORD_PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s, _ in self.special) + ")") if self.special else None
        for text, token in self.special:
            self.labels += [b""] * (token + 1 - len(self.labels))
            self.labels[token] = text.encode()
        self.step, self.step_row, self.token = tables["step"], tables["step_row"], tables["token"]
        self.kept_bytes = 0
        self.known: dict[str, tuple[str, bytes, int]] = {}

    def _has_arc(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state after ``last`` (-1: the start) has an arc for ``token``."""
        key = self.row[last] * self.stride + self.number[token]
        at = np.searchsorted(self.low, key, "right") - 1
        return (last < 0) | (at < 0) | (self.high[at] < key)

    def paths(self, words: list[bytes]) -> list[np.ndarray]:
        """The token path of each word."""
        found: list[np.ndarray | None] = [None] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for bound in (8, 16, 32, _LONG_WORD):
            chosen = np.flatnonzero((lengths > bound // 2 if bound > 8 else lengths > 0) & (lengths <= bound))
            if len(chosen):
                for k, path in zip(chosen.tolist(), self._together([words[k] for k in chosen], bound), strict=True):
                    found[k] = path
        for k in np.flatnonzero(lengths > _LONG_WORD).tolist():
            found[k] = self._alone(words[k])
        return [p if p is not None else np.zeros(0, np.int32) for p in found]

    def _together(self, words: list[bytes], width: int) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        lengths = np.array([len(w) for w in words])
        last = np.full((len(words), width + 1), -1, np.int32)  # the token that ends at each place
        for begin in range(width):
            who = np.flatnonzero(lengths > begin)
            if not len(who):
                break
            node, place = np.zeros(len(who), np.int32), begin
            while len(who):
                node = self.step[self.step_row[node], data[who, place]]
                place += 1
                alive = node > 0
                token = self.token[node]
                asked = np.flatnonzero(alive & (token >= 0))
                if len(asked):
                    right = asked[self._has_arc(last[who[asked], begin], token[asked])]
                    last[who[right], place] = token[right]
                alive &= lengths[who] > place
                who, node = who[alive], node[alive]
        count = np.zeros(len(words), np.int64)
        back = np.full((len(words), width), -1, np.int32)
        place, who = lengths.copy(), np.arange(len(words))
        while len(who):
            token = last[who, place[who]]
            back[who, count[who]] = token
            count[who] += 1
            place[who] -= self.lengths[token]
            who = who[place[who] > 0]
        return [back[k, :n][::-1] for k, n in enumerate(count.tolist())]

    def _alone(self, word: bytes) -> np.ndarray:
        """A word too long for the common table, such as an unbroken line of letters."""
        last = np.full(len(word) + 1, -1, np.int32)
        for begin in range(len(word)):
            node, ends, tokens = 0, [], []
            for place in range(begin, len(word)):
                node = int(self.step[self.step_row[node], word[place]])
                if not node:
                    break
                if self.token[node] >= 0:
                    ends.append(place + 1)
                    tokens.append(int(self.token[node]))
            tokens_ = np.array(tokens, np.int64)
            right = self._has_arc(np.full(len(tokens_), last[begin]), tokens_)
            last[np.array(ends)[right]] = tokens_[right]
        path, place = [], len(word)
        while place:
            path.append(int(last[place]))
            place -= int(self.lengths[path[-1]])
        return np.array(path[::-1], np.int32)

    def pieces(self, text: str) -> list[str]:
        """Words of a text; the strings of special tokens stand alone."""
        if self.split is None or not any(s in text for s, _ in self.special):
            return self.words.findall(text)
        special = {s for s, _ in self.special}
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in special else self.words.findall(part)
        return out

    def learn(self, lists: list[list[str]]) -> None:
        """Encode the words of these lists that are not yet remembered."""
        if self.kept_bytes > CACHED_BYTES:
            self.known.clear()
            self.kept_bytes = 0
        if not self.known:
            self.known.update({s: (str(i), self.labels[i], 1) for s, i in self.special})
        fresh = list(set().union(*lists).difference(self.known)) if lists else []
        for path, word in zip(self.paths([w.encode("utf-8", "surrogatepass") for w in fresh]), fresh, strict=True):
            ids = path.tolist()
            entry = self.known[word] = (",".join(map(str, ids)), self.decode(ids), len(ids))
            self.kept_bytes += 300 + 2 * len(entry[1]) + len(entry[0])  # the objects take about 300 bytes

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, one after another."""
        labels = self.labels
        return b"".join([labels[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        words = self.pieces(text)
        self.learn([words])
        return [int(i) for w in words for i in self.known[w][0].split(",")]

    def _slices(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        """Words of the texts, a bounded stretch of text at a time, all of them encoded."""
        begin = 0
        while begin < len(texts):
            end, chars = begin, 0
            while end < len(texts) and (end == begin or chars < SLICE_CHARS):
                chars += len(texts[end] or "")
                end += 1
            lists = [self.pieces(t or "") for t in texts[begin:end]]
            self.learn(lists)
            yield lists
            begin = end

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text."""
        known, out = self.known, []
        for lists in self._slices(texts):
            out += [sum([known[w][2] for w in words]) for words in lists]
        return out

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of tokens, digest of the ids, digest of the decoded text."""
        known = self.known
        for lists in self._slices(texts):
            for words in lists:
                parts = [known[w] for w in words]
                ids = ",".join([p[0] for p in parts])
                decoded = b"".join([p[1] for p in parts]).decode("utf-8", "replace")
                yield (
                    ids.count(",") + 1 if ids else 0,
                    hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                )


class SharedTables:
    """Tables sent to the executors once."""

    def __init__(self, spark, tables: dict):
        self._broadcast = spark.sparkContext.broadcast(tables)

    def encoder(self) -> Encoder:
        """A task's own encoder; its tables are the worker's copy, its words go with the task."""
        return Encoder(self._broadcast.value)


def shared_tables(spark, vocabulary: str) -> SharedTables:
    python_ready(spark)
    return SharedTables(spark, compile_automaton(vocabulary))


def encode_digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row's whole text.

    Null and empty texts have no tokens and the digests of the empty string. Rows with a null or
    repeated id stay rows of their own; other columns are not read. No row is moved: the automaton,
    whose size depends on the vocabulary alone, is broadcast.
    """
    shared = shared_tables(docs.sparkSession, vocabulary)
    columns = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def task():
        encoder = shared.encoder()
        return lambda texts: [list(x) for x in zip(*encoder.digests(texts), strict=True)] or [[], [], []]

    return map_texts(docs, doc_id, text, columns, start=task)
