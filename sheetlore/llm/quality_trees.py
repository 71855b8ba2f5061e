"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and words of the whole text. Trees are grown leaf by level on binned
features with the logistic loss; after fitting they are flattened into arrays, and a batch of
documents walks all trees together with numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlore.llm.common import fold, map_texts, parts, python_ready, tidy
from sheetlore.llm.learning import TRAINING_ROWS, labelled_sample, sigmoid

THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, PENALTY = 120, 4, 64, 0.15, 1.0, 1.0

_PUNCTUATION = b".,;:!?-'\"()|#$%&*/<>=_@+[]{}"
_KINDS = {
    "lower": np.arange(97, 123), "upper": np.arange(65, 91), "digit": np.arange(48, 58),
    "high": np.arange(128, 256), "space": np.array([32]), "line": np.array([10]),
    "control": np.array([*range(0, 9), *range(14, 32), 127]),
}
FEATURES = (
    ["log_bytes", "log_words", "log_lines", *_KINDS, *(f"byte_{b}" for b in _PUNCTUATION)]
    + ["word_length", "distinct_words", "top_word", "top_three_words", "odd_ends", "upper_words", "single_letters",
       "line_length", "repeated_lines", "words_a_stop", "longest_word", "half_a", "half_b"]
)


def statistics(text: str) -> list[float]:
    """Features of one text; all zero for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = len(raw)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    top = sorted(seen.values(), reverse=True)[:3] or [0]
    # Every word is looked at, once by each generator below.
    odd = sum([not w[-1].isalnum() and w[-1] not in ".,;:?)" for w in words])
    shouted = sum([len(w) > 1 and w.isupper() for w in words])
    single = sum([len(w) == 1 for w in words])
    stops = counts[46] + counts[33] + counts[63]
    half = len(words) // 2
    halves = [sum([not w[-1].isalnum() and w[-1] not in ".,;:?)" or len(w) == 1 or w.isupper() for w in part]) / max(1, len(part)) for part in (words[:half], words[half:])]
    return [
        np.log1p(total), np.log1p(len(words)), np.log1p(len(lines)),
        *(counts[k].sum() / total for k in _KINDS.values()),
        *(counts[b] / total for b in _PUNCTUATION),
        sum(map(len, words)) / n, len(seen) / n, top[0] / n, sum(top) / n, odd / n, shouted / n, single / n,
        total / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / (1 + stops), max(map(len, words), default=0), *halves,
    ]


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Boosted trees as arrays: for node k of tree t a feature, a cut and, in the last level, a value.

    Trees are complete: children of node k are 2k+1 (value <= cut) and 2k+2; a node that is not
    split sends everything left. Without both classes the model is the constant share.
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = np.log(share / (1 - share))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut, value = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), start)
        flat = binned + np.arange(x.shape[1]) * BINS
        for t in range(TREES):
            p = sigmoid(score)
            gradient, hessian = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first = 2**level - 1
                for k in range(first, 2 * first + 1):
                    here = np.flatnonzero(node == k)
                    node[here] = 2 * k + 1
                    if len(here) < 10:
                        continue
                    size = x.shape[1] * BINS
                    g = np.bincount(flat[here].ravel(), np.repeat(gradient[here], x.shape[1]), size).reshape(-1, BINS).cumsum(axis=1)
                    h = np.bincount(flat[here].ravel(), np.repeat(hessian[here], x.shape[1]), size).reshape(-1, BINS).cumsum(axis=1)
                    g_all, h_all = g[0, -1], h[0, -1]
                    gain = g**2 / (h + PENALTY) + (g_all - g) ** 2 / (h_all - h + PENALTY) - g_all**2 / (h_all + PENALTY)
                    gain[(h < LEAST_HESSIAN) | (h_all - h < LEAST_HESSIAN)] = -1
                    f, b = divmod(int(gain.argmax()), BINS)
                    if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                        continue
                    feature[t, k], cut[t, k] = f, cuts[f][b]
                    node[here[binned[here, f] > b]] = 2 * k + 2
            leaf = node - inner
            value[t] = -RATE * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + PENALTY)
            score += value[t, leaf]
    return {"feature": feature, "cut": cut, "value": value, "start": np.array(start)}


def scores(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities; all rows and trees go down one level at a time."""
    trees = np.arange(len(model["value"]))[None, :]
    node = np.zeros((len(x), trees.shape[1]), np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        right = x[rows, model["feature"][trees, node]] > model["cut"][trees, node]
        node = 2 * node + 1 + right
    return sigmoid(model["start"] + model["value"][trees, node - (2**DEPTH - 1)].sum(axis=1))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    """A model from labelled documents outside the held-out fifth; at most ``rows`` of them.

    Statistics are computed by Spark; only they, never texts, come to the driver.
    """
    sample = labelled_sample(docs, labels, "quality", rows, fold("doc_id", 5) != 0)
    found = map_texts(sample.select(F.struct("doc_id", "label").alias("key"), "text"), "key", "text", {"x": "array<double>"}, lambda texts: [[statistics(t) for t in texts]])
    got = found.select("doc_id.doc_id", "doc_id.label", "x").orderBy("doc_id").collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array([r["label"] for r in got], float))


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row's whole text; null counts as empty.

    Rows stay where they are; repeated rows and null ids get scores like any other.
    """
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]) -> list[np.ndarray]:
        x = np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))
        return [scores(shared.value, x)]

    return map_texts(docs, doc_id, text, {"score": "double"}, score)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; held-out labels are never read."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns, unmoved."""
    python_ready(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            x = np.array([statistics(t or "") for t in batch.column(place).to_pylist()], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(scores(shared.value, x) >= threshold))

    return docs.mapInArrow(tidy(keep), docs.schema)
