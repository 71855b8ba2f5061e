"""Spelling variants by composing a minimised vocabulary acceptor with a one-edit transducer and itself.

Two words that differ by one code point share either the first half of the shorter one or the rest of it.
So the vocabulary is dealt out by the state in which an acceptor is after that half, forwards or
backwards, for each length of the shorter word. From such an initial state the remainders of the words
make a minimised acceptor A. The composition A o E o A, with E the transducer that copies symbols and
edits exactly one, is walked from state pairs that E has not edited yet: a state with itself, from where
one replaced or inserted symbol leads to two states whose common remainders are the pairs accepted.
Common remainders are found once per pair of states, and words are numbered by the acceptor's counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlore.llm.common import FOLDED, parts, python_ready, stored
from sheetlore.llm.merkle_log import CRC32, CRC_TABLE

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A word's form has at least this many times its occurrences.
TIMES = 5
#: A run of letters loses a code point where its hash is divisible by this.
STRUCK = 199
#: Words that a counting task holds before it passes on their counts.
HELD_WORDS = 200_000
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_FOLD = bytes(FOLDED)
#: Texts of more characters are read run by run, not listed.
_LONG_TEXT = 1_000_000


def runs_of(text: str) -> Counter:
    """Maximal runs of enough letters, with A-Z in lower case, and how often they occur."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass")
    if len(folded) > _LONG_TEXT:
        return Counter(m.group() for m in _RUN.finditer(folded))
    return Counter(_RUN.findall(folded))


def struck(run: str, prefix: int) -> str:
    """The run, or the run without one code point; ``prefix`` is the hash of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % STRUCK:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in parts(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            prefix = zlib.crc32(f"{doc_id}:".encode())
            for run, n in runs_of(text).items():
                held[struck(run, prefix)] += n
            if len(held) > HELD_WORDS:
                yield from _counts(held)
                held.clear()
    yield from _counts(held)


def _counts(held: Counter) -> Iterator[pa.RecordBatch]:
    words = [w for w in held if len(w) >= LEAST_LENGTH]
    for k in range(0, len(words), 50_000):
        some = words[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[w] for w in some], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of enough code points that occur often enough in all texts."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    counted = rows.mapInArrow(_count, "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT), "vocabulary")


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words; children have smaller numbers than parents."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []  # symbol: (state, words before those through the arc)
        self.count: list[int] = []
        self.span: list[tuple[int, int]] = []  # least and greatest length of what is accepted
        self._register: dict[tuple, int] = {}
        path: list[tuple[list, list]] = [([False], [])]
        last = ""
        for word in words:
            common = 0
            while common < len(last) and common < len(word) and last[common] == word[common]:
                common += 1
            self._close(path, last, common)
            path += [([False], []) for _ in word[common:]]
            path[-1][0][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._state(path[0])

    def _close(self, path: list, last: str, depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], self._state(node)))

    def _state(self, node: tuple[list, list]) -> int:
        final, arcs = node[0][0], tuple(node[1])
        number = self._register.get((final, arcs))
        if number is None:
            number = self._register[final, arcs] = len(self.final)
            before, own, low, high = int(final), {}, [0] if final else [], 0
            for symbol, child in arcs:
                own[symbol] = (child, before)
                before += self.count[child]
                low.append(self.span[child][0] + 1)
                high = max(high, self.span[child][1] + 1)
            self.final.append(final)
            self.arcs.append(own)
            self.count.append(before)
            self.span.append((min(low, default=0), high))
        return number


class Composition:
    """Pairs of words accepted by A o (one edit) o A, as numbers of words in order."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self._common: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def pairs(self) -> set[tuple[int, int]]:
        a, unedited = self.a, []
        for p, arcs in enumerate(a.arcs):  # children first
            found: list[tuple[int, int]] = []
            listed = list(arcs.values())
            for k, (child, before) in enumerate(listed):
                found += [(i + before, j + before) for i, j in unedited[child]]
                for other, after in listed[k + 1 :]:  # one symbol replaced
                    found += [(i + before, j + after) for i, j in self.common(child, other)]
                found += [(i, j + before) for i, j in self.common(p, child)]  # one symbol inserted
            unedited.append(list(set(found)))  # a symbol inserted in a run of its like is found at each place
        return {(min(x), max(x)) for x in unedited[a.start]}

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """Numbers, from p and from q, of the remainders that both accept."""
        a, known = self.a, self._common
        waiting = [(p, q)]
        while waiting:
            one, two = pair = waiting[-1]
            if pair in known:
                waiting.pop()
                continue
            if one == two:
                known[pair] = [(k, k) for k in range(a.count[one])]
                continue
            (low, high), (low_, high_) = a.span[one], a.span[two]
            if low > high_ or low_ > high:
                known[pair] = []
                continue
            left, right = a.arcs[one], a.arcs[two]
            shared = [s for s in left if s in right]
            missing = [(left[s][0], right[s][0]) for s in shared if (left[s][0], right[s][0]) not in known]
            if missing:
                waiting += missing
                continue
            out = [(0, 0)] if a.final[one] and a.final[two] else []
            for s in shared:
                (child, before), (child_, before_) = left[s], right[s]
                out += [(i + before, j + before_) for i, j in known[child, child_]]
            known[pair] = out
        return known[p, q]


def near_pairs(words: list[str]) -> list[tuple[str, str]]:
    """Pairs of the given words that differ by exactly one inserted, deleted or replaced code point."""
    ordered = sorted(set(words))
    if len(ordered) < 2:
        return []
    return [(ordered[i], ordered[j]) for i, j in sorted(Composition(Acceptor(ordered)).pairs())]


def partition_pairs(key: str, words: list[str]) -> Iterator[tuple[str, str]]:
    """The near pairs that an initial state answers for, each pair in one state only.

    ``key`` is F or B, the shorter word's length, a colon and the shared half. A pair belongs to the
    forward state if it shares that half, else to the backward one.
    """
    length, half = int(key[1 : key.index(":")]), key[key.index(":") + 1 :]
    forward, first = key[0] == "F", length // 2
    rest = {(w[first:] if forward else w[: len(w) - len(half)][::-1]): w for w in words}
    for x, y in near_pairs(list(rest)):
        one, two = rest[x], rest[y]
        if min(len(one), len(two)) == length and (forward or one[:first] != two[:first]):
            yield one, two


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per initial state: words with the number of their near words there, and the best of them."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    held: list[tuple] = []
    for key, group in groupby(rows(), key=lambda r: r[0]):
        count = {word: n for _, word, n in group}
        if len(count) < 2:
            continue
        best: dict[str, tuple[int, int, str]] = {}  # near words, minus the best one's n, the best one
        for pair in partition_pairs(key, list(count)):
            for word, other in (pair, pair[::-1]):
                near, n, form = best.get(word, (0, 0, ""))
                best[word] = (near + 1, *(min((n, form), (-count[other], other)) if near else (-count[other], other)))
        held += [(w, *x) for w, x in best.items()]
        if len(held) > 10_000:
            yield _pairs_batch(held)
            held = []
    if held:
        yield _pairs_batch(held)


def _pairs_batch(held: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], ["word", "near", "less", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of less = -n and form) of the words (word, n) that have near words."""
    python_ready(words.sparkSession)
    size = F.length("word")
    keys = []
    for length in (size, size - 1):  # as the shorter word of a pair, and as the longer one
        first = F.floor(length / 2).cast("int")
        rest = (length - first).cast("int")
        keys.append(F.concat(F.lit("F"), length.cast("string"), F.lit(":"), F.substring("word", F.lit(1), first)))
        keys.append(F.concat(F.lit("B"), length.cast("string"), F.lit(":"), F.substring("word", -rest, rest)))
    states = F.when(size > LEAST_LENGTH, F.array(*keys)).otherwise(F.array(*keys[:2]))
    dealt = words.select(F.explode(states).alias("state"), "word", "n").repartition("state").sortWithinPartitions("state", "word")
    found = dealt.mapInArrow(_near, "word string, near long, less long, form string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. Chains rise TIMES-fold in n each step; each round doubles the steps taken."""
    roots = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(further, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word of the vocabulary with its form and root: word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of at least 6 code points with
    at least 5 occurrences in all texts, after runs whose hash with the id is divisible by 199 have
    lost a code point. A word's form is the near word of greatest n (ties: the first in code-point
    order) if it has at least 5 times the word's n; its root is where the chain of forms ends. Null and
    empty texts have no words, a null id counts as empty in the hash, repeated rows count each time.
    Other columns are not read; an empty table gives an empty one.
    """
    words = vocabulary(docs, doc_id, text)
    found = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("best"), (-F.col("best.less")).alias("best_n")
    )
    enough = F.col("best_n") >= TIMES * F.col("n")
    forms = stored(found.select("word", "n", "n_near", F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


_BYTES = """flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
  ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))"""
_HASH = CRC32.replace("list_transform(string_split(%s, ''), lambda x: ascii(x)::BIGINT)", f"list_concat(list_transform(string_split(doc_id || ':', ''), lambda x: ascii(x)::BIGINT), {_BYTES})")
SPELLING_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM found WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, times, {_HASH} AS h FROM each, crc),
words AS (
  SELECT CASE WHEN h % {STRUCK} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(times) >= {LEAST_COUNT}),
cut AS (SELECT DISTINCT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM words, generate_series(1, length(word)) AS g(k)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.at WHERE e.form IS NULL
"""
