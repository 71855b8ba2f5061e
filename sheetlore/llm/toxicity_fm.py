"""Toxicity classifier: a factorization machine over hashed terms.

Terms are the words of a text and the first bytes of longer words, hashed into a fixed space. A term
adds its weight, and every pair of terms the inner product of two learned vectors, so that a pair such
as an insult with a group's name can count where neither does alone. Terms enter the machine if they
tell by themselves, either way, or in a pair: all pairs of the most frequent and most telling terms are
counted, and those taken whose log odds differ from what their terms give apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlore.llm.common import LETTERS, fold, map_texts, parts, python_ready, slices, stored, word_hashes
from sheetlore.llm.learning import labelled_sample, sigmoid

THRESHOLD = 0.5
#: Documented bound of the training sample.
TRAINING_ROWS = 12_000
SPACE_BITS, TERMS, FACTORS = 22, 4096, 8
PREFIXES = (4, 5, 6, 7, 8)
#: Texts that a chosen term occurs in at least, and standard errors that its log odds lie from 0.
LEAST_TEXTS, LEAST_Z = 4, 2.0
#: Terms of which all pairs are counted: the most frequent and the most telling ones.
FREQUENT, TELLING = 512, 256
#: Pairs taken at most, and standard errors that a pair's log odds differ from those of its terms apart.
PAIRS, LEAST_PAIR_Z = 128, 5.0
EPOCHS, BATCH, STEP, DECAY = 40, 256, 0.02, 2e-3


def term_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct hashed terms of each whole text."""
    out = []
    for begin, end in slices(texts):
        hashes, bounds, *first = word_hashes([t.lower() for t in texts[begin:end]], PREFIXES, LETTERS)
        every = np.stack([hashes, *first]) >> np.uint64(64 - SPACE_BITS)
        out += [np.unique(every[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _counted(sample: DataFrame) -> DataFrame:
    """term, clean, toxic: in how many texts of each class a term occurs, and its z.

    Each task counts its texts in two arrays of fixed size and passes on the terms it has met.
    """
    python_ready(sample.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2**SPACE_BITS), np.int64)
        for batch in parts(batches):
            for label, found in zip(batch.column(0).to_pylist(), term_sets(batch.column(1).to_pylist()), strict=True):
                seen[label, found.astype(np.int64)] += 1
        met = np.flatnonzero(seen.any(axis=0))
        for k in range(0, len(met), 100_000):
            part = met[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])], ["term", "clean", "toxic"])

    counted = sample.select("label", "text").mapInArrow(count, "term long, clean long, toxic long")
    sums = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
    of = sample.agg(F.sum("label").alias("toxic"), F.count("*").alias("rows")).first()
    toxic, clean = of["toxic"] or 0, of["rows"] - (of["toxic"] or 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    return stored(sums.select("term", "clean", "toxic", (odds / spread).alias("z")), "term-counts")


def interacting_pairs(both: np.ndarray, alone: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """z of each pair of terms: how far its log odds are from what its terms give if they do not interact.

    ``both`` has per class (clean, toxic) how many texts have a pair, ``alone`` a term, ``rows`` all texts.
    """
    by_chance = alone[:, :, None] * alone[:, None, :] / np.maximum(rows, 1)[:, None, None]
    lift = np.log((both + 0.5) / (by_chance + 0.5))
    z = (lift[1] - lift[0]) / np.sqrt(1 / (both[0] + 0.5) + 1 / (both[1] + 0.5))
    return np.triu(z, 1)


def _pair_terms(sample: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Terms of the pairs that tell most beyond what their terms tell apart; counted by tasks over the whole sample."""
    size = len(terms)
    if size < 2:
        return terms[:0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size + 1, size + 1), np.float64)
        for batch in parts(batches):
            rows = term_sets(batch.column(1).to_pylist())
            labels = np.array(batch.column(0).to_pylist())
            present = np.zeros((len(rows), size + 1), np.float32)
            present[:, size] = 1  # stands for the text itself: alone with a term, it counts the term
            for k, found in enumerate(rows):
                present[k, _hits(found, terms)] = 1
            for label in (0, 1):
                own = present[labels == label]
                seen[label] += own.T @ own
        for one in range(size + 1):
            met = np.flatnonzero(seen[:, one].any(axis=0))
            met = met[met >= one]
            if len(met):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one * (size + 1) + met), *(pa.array(seen[k, one, met].astype(np.int64)) for k in (0, 1))], ["pair", "clean", "toxic"]
                )

    counted = sample.select("label", "text").mapInArrow(count, "pair long, clean long, toxic long").groupBy("pair")
    both = np.zeros((2, size + 1, size + 1))
    for r in counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect():  # (FREQUENT + TELLING) ** 2 / 2 rows at most
        both[:, r["pair"] // (size + 1), r["pair"] % (size + 1)] = r["clean"], r["toxic"]
    z = np.abs(interacting_pairs(both[:, :size, :size], both[:, :size, size], both[:, size, size]))
    best = np.argsort(-z, axis=None, kind="stable")[:PAIRS]
    best = best[z.ravel()[best] >= LEAST_PAIR_Z]
    return terms[np.unique(np.concatenate(np.unravel_index(best, z.shape)))]


def telling_terms(sample: DataFrame, terms: int = TERMS) -> np.ndarray:
    """Hashed terms that tell the classes apart, the surest first, and terms that do so in pairs."""
    counted = _counted(sample)
    sure = F.abs("z")
    chosen = counted.filter(sure >= LEAST_Z).orderBy(F.desc(sure), "term").limit(terms).select("term").collect()
    frequent = counted.orderBy(F.desc(F.col("clean") + F.col("toxic")), "term").limit(FREQUENT).select("term").collect()
    telling = np.array([r["term"] for r in chosen], np.uint64)
    some = np.unique(np.concatenate((telling[:TELLING], np.array([r["term"] for r in frequent], np.uint64))))
    return np.unique(np.concatenate((telling, _pair_terms(sample, some))))


def _hits(found: np.ndarray, terms: np.ndarray) -> np.ndarray:
    if not len(terms):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    return at[terms[at] == found]


def _raw(model: dict[str, np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    weight = 1 / np.sqrt(1.0 + sizes)[owner]
    linear = np.bincount(owner, model["weight"][flat] * weight, len(rows))
    v = model["factor"][flat] * weight[:, None]
    summed = np.stack([np.bincount(owner, v[:, f], len(rows)) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(owner, (v**2).sum(axis=1), len(rows))
    return model["bias"][0] + linear + 0.5 * ((summed**2).sum(axis=1) - squares), flat, owner, weight, summed


def fit_machine(rows: list[np.ndarray], y: np.ndarray, terms: int) -> dict[str, np.ndarray]:
    """Adam on the logistic loss; rows are indices of present terms. One class only gives a constant."""
    rng = np.random.default_rng(11)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = {"bias": np.array([np.log(share / (1 - share))]), "weight": np.zeros(terms), "factor": rng.normal(0, 0.01, (terms, FACTORS))}
    if not len(y) or y.sum() in (0, len(y)) or not terms:
        return model
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            part = order[k : k + BATCH]
            score, flat, owner, weight, summed = _raw(model, [rows[i] for i in part])
            error = (sigmoid(score) - y[part]) / len(part)
            v = model["factor"][flat] * weight[:, None]
            slope = {
                "bias": np.array([error.sum()]),
                "weight": np.bincount(flat, error[owner] * weight, terms) + DECAY * model["weight"] / len(y) * BATCH,
                "factor": np.zeros_like(model["factor"]),
            }
            pull = (error[owner] * weight)[:, None] * (summed[owner] - v)
            np.add.at(slope["factor"], flat, pull)
            slope["factor"] += DECAY * model["factor"] / len(y) * BATCH
            step += 1
            for name, g in slope.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model[name] = model[name] - STEP * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    """A model from labelled documents outside the held-out fifth; at most ``rows`` of them.

    Terms are counted by Spark; the driver gets the chosen terms and which of them each row has.
    """
    sample = labelled_sample(docs, labels, "toxic", rows, fold("doc_id", 5) != 0)
    terms = telling_terms(sample)
    keyed = sample.select(F.struct("doc_id", "label").alias("key"), "text")
    found = map_texts(keyed, "key", "text", {"hits": "array<long>"}, lambda texts: [[_hits(t, terms).tolist() for t in term_sets(texts)]])
    got = found.select("doc_id.doc_id", "doc_id.label", "hits").orderBy("doc_id").collect()
    rows_ = [np.array(r["hits"], np.int64) for r in got]
    return fit_machine(rows_, np.array([r["label"] for r in got], float), len(terms)) | {"terms": terms}


def score_toxicity(docs: DataFrame, model: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher is more toxic) of every row's whole text; null counts as empty.

    Rows stay where they are; repeated rows and null ids get scores like any other.
    """
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]) -> list[np.ndarray]:
        model = shared.value
        return [sigmoid(_raw(model, [_hits(t, model["terms"]) for t in term_sets(texts)])[0])]

    return map_texts(docs, doc_id, text, {"score": "double"}, score)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; held-out labels are never read."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
