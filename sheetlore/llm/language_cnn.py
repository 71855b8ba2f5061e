"""Language identification by a convolutional network over bytes.

A window of fixed length is embedded byte by byte, filters of several widths slide over it, the
greatest response of each filter is kept, and a softmax layer turns these into language
probabilities. It is trained here with numpy. For prediction embedding and filters are folded into
tables of byte pairs, so a position costs two table rows; every window of a text counts, by its letters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlore.llm.common import FOLDED, fold, map_texts, python_ready, slices

#: Documented bounds of the training sample: documents, and windows of each.
TRAINING_ROWS, TRAINING_WINDOWS = 6_000, 4
WINDOW, WIDTHS, FILTERS, EMBEDDING = 64, (2, 3, 4), 8, 8
EPOCHS, BATCH, STEP = 6, 128, 0.01
UNKNOWN = "und"
_REACH = max(WIDTHS) - 1
_ALPHABETIC = np.zeros(256, np.float32)
_ALPHABETIC[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _windows(text: str) -> np.ndarray:
    """Starts of all windows with the bytes behind them that filters reach: shape (n, WINDOW + reach)."""
    raw = FOLDED[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    n = -(-len(raw) // WINDOW)
    padded = np.zeros(n * WINDOW + _REACH, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + _REACH)[::WINDOW] if n else np.zeros((0, WINDOW + _REACH), np.uint8)


def train(windows: np.ndarray, y: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy; only the winning position of a filter passes its gradient on."""
    rng = np.random.default_rng(5)
    p: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.5, (256, EMBEDDING))}
    for w in WIDTHS:
        p[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
        p[f"bias{w}"] = np.zeros(FILTERS)
    p["out"], p["out_bias"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)), np.zeros(classes)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            part = order[k : k + BATCH]
            bytes_, target = windows[part], y[part]
            n = len(part)
            embedded = p["embed"][bytes_]
            pooled, won, patches = [], [], []
            for w in WIDTHS:
                patch = np.concatenate([embedded[:, j : j + WINDOW] for j in range(w)], axis=2)
                answer = patch @ p[f"conv{w}"] + p[f"bias{w}"]
                best = answer.argmax(axis=1)
                won.append(best)
                patches.append(patch)
                pooled.append(np.take_along_axis(answer, best[:, None], axis=1)[:, 0])
            h = np.concatenate(pooled, axis=1)
            active = np.maximum(h, 0)
            logits = active @ p["out"] + p["out_bias"]
            probability = np.exp(logits - logits.max(axis=1, keepdims=True))
            probability /= probability.sum(axis=1, keepdims=True)
            d = probability
            d[np.arange(n), target] -= 1
            d /= n
            slope = {"out": active.T @ d, "out_bias": d.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            dh = (d @ p["out"].T) * (h > 0)
            rows = np.arange(n)[:, None]
            for i, w in enumerate(WIDTHS):
                own = dh[:, i * FILTERS : (i + 1) * FILTERS]
                chosen = patches[i][rows, won[i]]
                slope[f"conv{w}"] = np.einsum("nfe,nf->ef", chosen, own)
                slope[f"bias{w}"] = own.sum(axis=0)
                back = np.einsum("nf,ef->nfe", own, p[f"conv{w}"]).reshape(n, FILTERS, w, EMBEDDING)
                for j in range(w):
                    np.add.at(slope["embed"], bytes_[rows, won[i] + j], back[:, :, j])
            step += 1
            for name, g in slope.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] = p[name] - STEP * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return p


def pair_tables(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Responses of all filters to the first and to the last two of four bytes."""
    single = np.zeros((_REACH + 1, 256, len(WIDTHS) * FILTERS), np.float32)
    bias = np.concatenate([p[f"bias{w}"] for w in WIDTHS])
    for i, w in enumerate(WIDTHS):
        kernel = p[f"conv{w}"].reshape(w, EMBEDDING, FILTERS)
        for j in range(w):
            single[j, :, i * FILTERS : (i + 1) * FILTERS] = p["embed"] @ kernel[j]
    front = single[0][:, None] + single[1][None, :] + bias.astype(np.float32)
    rear = single[2][:, None] + single[3][None, :]
    return {
        "front": front.reshape(65536, -1).astype(np.float32), "rear": rear.reshape(65536, -1),
        "out": p["out"].astype(np.float32), "out_bias": p["out_bias"].astype(np.float32),
    }


def window_probabilities(model: dict[str, np.ndarray], windows: np.ndarray, together: int = 4096) -> np.ndarray:
    """Softmax of each window; a bounded number of windows is in memory at a time."""
    out = np.zeros((len(windows), len(model["out_bias"])), np.float32)
    for k in range(0, len(windows), together):
        part = windows[k : k + together].astype(np.int32)
        pair = part[:, :-1] * 256 + part[:, 1:]
        answer = np.take(model["front"], pair[:, :WINDOW], axis=0)
        answer += np.take(model["rear"], pair[:, 2 : WINDOW + 2], axis=0)
        logits = np.maximum(answer.max(axis=1), 0) @ model["out"] + model["out_bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[k : k + together] = e / e.sum(axis=1, keepdims=True)
    return out


def predict(model: dict, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and its mean probability over a text's windows; ``und`` and 0 without a letter."""
    names, scores = [], []
    for begin, end in slices(texts, 1_000_000):
        each = [_windows(t) for t in texts[begin:end]]
        bounds = np.cumsum([0, *map(len, each)])
        windows = np.concatenate(each)
        weights = _ALPHABETIC[windows[:, :WINDOW]].sum(axis=1)
        weighted = window_probabilities(model, windows) * weights[:, None]
        totals = np.concatenate((np.zeros((1, weighted.shape[1])), np.cumsum(weighted, axis=0, dtype=np.float64)))
        sums, letters = totals[bounds[1:]] - totals[bounds[:-1]], np.concatenate(([0.0], np.cumsum(weights, dtype=np.float64)))
        share = sums / np.maximum(1e-9, letters[bounds[1:]] - letters[bounds[:-1]])[:, None]
        for text, row in zip(texts[begin:end], share, strict=True):
            known = model["classes"] and any(map(str.isalpha, text))
            names.append(model["classes"][int(row.argmax())] if known else UNKNOWN)
            scores.append(min(1.0, max(0.0, float(row.max()))) if known else 0.0)
    return names, scores


def fit_language(docs: DataFrame, learn: Column, rows: int = TRAINING_ROWS) -> dict:
    """A model from documents with a language for which ``learn`` holds; at most ``rows`` of them.

    The sample is those whose hashed id comes first. Only windows of fixed length come to the
    driver, TRAINING_WINDOWS evenly spaced ones a document; no window is taken for its place in a text.
    """
    chosen = (
        docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .select("doc_id", "lang").distinct()
        .withColumn("draw", F.xxhash64(F.lit("sample"), "doc_id")).orderBy("draw", "doc_id", "lang").limit(rows).drop("draw")
    )
    own = docs.filter("text IS NOT NULL").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])

    def cut(texts: list[str]) -> list[list]:
        out = []
        for text in texts:
            windows = _windows(text)
            picked = np.unique(np.linspace(0, max(0, len(windows) - 1), TRAINING_WINDOWS).astype(int))
            out.append([windows[k].tobytes() for k in picked] if len(windows) and any(map(str.isalpha, text)) else [])
        return [out]

    keyed = own.select(F.struct("doc_id", "lang").alias("key"), "text")
    found = map_texts(keyed, "key", "text", {"windows": "array<binary>"}, cut).select("doc_id.doc_id", "doc_id.lang", F.explode("windows").alias("window"))
    got = found.orderBy("doc_id", "lang", "window").collect()
    classes = sorted({r["lang"] for r in got})
    if not classes:
        return {"classes": []} | pair_tables(train(np.zeros((0, WINDOW + _REACH), np.uint8), np.zeros(0, int), 1))
    windows = np.frombuffer(b"".join(r["window"] for r in got), np.uint8).reshape(-1, WINDOW + _REACH)
    y = np.array([classes.index(r["lang"]) for r in got])
    return {"classes": classes} | pair_tables(train(windows, y, len(classes)))


def predict_language(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text. Null, empty and letterless texts are
    ``und`` with score 0; repeated rows and null ids get predictions like any other."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, doc_id, text, {"lang_pred": "string", "score": "double"}, lambda texts: list(predict(shared.value, texts)))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; held-out languages are never read."""
    predicted = predict_language(docs, fit_language(docs, fold("doc_id", 4) != 2))
    return predicted.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
