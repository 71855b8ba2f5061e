"""Repeated passages and the column-wise suffix order against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sheetlore.llm import suffix_dedup
from sheetlore.llm.suffix_dedup import LENGTH

SCHEMA = "doc_id long, text string, mark long, begin long, route string, kind int"
WORDS = [f"w{k}é"[: 2 + k % 4] + "x" * (k % 3) for k in range(400)]


def brute_force(rows):
    """rows: (doc_id, text), no two rows with one id but different texts. A repeated row has its twin's result."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        covered = np.zeros(len(raw) + 1, np.int64)
        for k in range(len(raw) - LENGTH + 1):
            window = raw[k : k + LENGTH]
            if window in seen:
                covered[k] += 1
                covered[k + LENGTH if k + LENGTH <= len(raw) else len(raw)] -= 1
            seen.add(window)
        gone = np.cumsum(covered)[: len(raw)] > 0
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[doc_id, text] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *out[r]) for r in rows), key=str)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rng = random.Random(4)
    shared = [prose(rng, rng.randint(20, 120)) for _ in range(12)]
    line = prose(rng, 60)
    rows = [(k, "\n".join(rng.choice(shared) if rng.random() < 0.3 else prose(rng, rng.randint(1, 90)) for _ in range(rng.randint(1, 6)))) for k in range(150)]
    rows += [(200 + k, f"{prose(rng, 15)} {line} {prose(rng, 15)}") for k in range(60)]  # one passage, always in other words
    rows += [(300 + k, rows[3][1]) for k in range(20)] + [(330 + k, rows[4][1][k:]) for k in range(20)]
    rows += [(400, "ab" * 900), (401, "a" * 2000), (402, "ba" * 80 + prose(rng, 30)), (403, "a" * 99), (404, "a" * 100), (405, "b" * 100 + "a" * 101)]
    rows += [(406, None), (407, ""), (408, "é" * 60 + "漢字" * 40), (409, "漢字" * 40 + "é" * 49), (None, rows[5][1]), (410, "\0" * 150), (411, "x" + "\0" * 120)]
    return rows + [rows[0], rows[0], (None, rows[5][1])]


def run(spark, rows, partitions=5):
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(partitions)
    got = suffix_dedup.repeated_passages(docs).collect()
    assert all(r.n_removed == sum(s.end - s.begin for s in r.spans) and r.n_spans == len(r.spans) for r in got)
    return sorted((tuple(r)[:5] for r in got), key=str)


def test_passages_equal_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute_force(rows)


def test_long_texts_and_stretches(spark, monkeypatch):
    rng = random.Random(9)
    long = prose(rng, 150_000)
    middle = long[300_000:300_400]
    rows = [(1, long), (2, middle + long[520_000:530_000] + prose(rng, 50)), (3, prose(rng, 90) + long), (4, "z" * 700_000)]
    assert run(spark, rows, 2) == brute_force(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_collection_is_the_suffix_order(alphabet):
    rng = random.Random(2)
    strings = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))).encode() for _ in range(60)]
    strings += strings[:5]
    built = suffix_dedup.Collection(strings).build()
    whole = b"".join(strings)
    ends = np.cumsum([len(s) for s in strings])
    order = sorted(
        ((s[k:], n, int(ends[n]) - len(s) + k) for n, s in enumerate(strings) for k in range(len(s) + 1)),
        key=lambda x: ([c + 1 for c in x[0]] + [0], x[1]),
    )
    assert built.start.tolist() == [x[2] for x in order]
    before = [0 if x[2] - len(strings[x[1]]) + len(x[0]) == int(ends[x[1]]) - len(strings[x[1]]) and len(x[0]) == len(strings[x[1]]) else whole[x[2] - 1] + 1 for x in order]
    assert built.bwt.tolist() == before
    for (one, _, _), (two, _, _), common in zip(order, order[1:], built.lcp[1:].tolist(), strict=False):
        shared = next((k for k, (a, b) in enumerate(zip(one, two, strict=False)) if a != b), min(len(one), len(two)))
        assert common == shared


def test_hot_and_full_anchors_change_nothing(spark, monkeypatch):
    """Cutting pieces into windows must not depend on which anchors are hot."""
    rows = corpus()
    texts = suffix_dedup._documents(spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA), "doc_id", "text")
    every = set()
    for held in suffix_dedup._held(iter([b for b in texts.toArrow().to_batches()]), np.zeros(0, np.uint64)):
        every.update(held.columns()[2][3].tolist())
    some = np.sort(np.array(sorted(every)[::3], np.uint64))
    monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda texts: some)
    assert run(spark, rows) == brute_force(rows)
    monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda texts: np.zeros(0, np.uint64))
    monkeypatch.setattr(suffix_dedup, "FULL", 3)
    assert run(spark, rows) == brute_force(rows)
