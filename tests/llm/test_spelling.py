"""Spelling variants: the composition against plain edit distances, the operator against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

from sheetlore.llm import spelling_groups

SCHEMA = "doc_id long, text string, word string, n long, form string, root string, state string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_force(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: best[w] if w in best and n[best[w]] >= 5 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_composition_finds_all_pairs_at_one_edit():
    rng = random.Random(1)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 40))})
        want = {p for p in itertools.combinations(words, 2) if one_edit(*p)}
        assert set(spelling_groups.near_pairs(words)) == want
    assert spelling_groups.near_pairs([]) == []
    long = "a" * 20_000
    assert spelling_groups.near_pairs([long, long + "a", long + "aa"]) == [(long, long + "a"), (long + "a", long + "aa")]
    long = "ab" * 20_000
    assert spelling_groups.near_pairs([long, long + "a", "b" + long]) == [(long, long + "a"), (long, "b" + long)]


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted(a + b for a in ("", "x", "yy") for b in ("ing", "ed", "s"))
    acceptor = spelling_groups.Acceptor(words)
    assert acceptor.count[acceptor.start] == len(words)
    assert len(acceptor.final) == len({(f, tuple(sorted(a.items()))) for f, a in zip(acceptor.final, acceptor.arcs, strict=True)})
    assert len(acceptor.final) < sum(map(len, words))


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "w", 1, "f", "r", "s") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in spelling_groups.spelling_variants(docs).collect())


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(12)]

    def variant(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w, w, w, w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "zÿ"[k % 2] + w[k + 1 :], w.upper()])

    rows = [(k, " ".join(variant(variant(rng.choice(stems))) for _ in range(40)) + "1abc÷def É") for k in range(300)]
    rows += [(None, rows[0][1]), (None, None), (500, ""), (7, rows[7][1]), (501, "Q" * 5000 + "\n" + "q" * 4999)] + [(502, "Q" * 5000)] * 6 + [(503, "q" * 4999)] * 5
    rows += [(600 + k, " ".join(["chaining"] * 200 + ["chainixg"] * 36 + ["chaixixg"] * 7)) for k in range(1)]
    want = brute_force(rows)
    assert any(r[1] and r[1] != r[2] for r in want) and any(len(r[0]) > 4000 and r[4] for r in want)
    assert run(spark, rows) == want


def test_ties_and_empty_tables(spark):
    assert run(spark, []) == []
    rows = [(1, " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdeh"] * 25))]
    assert run(spark, rows) == brute_force(rows)
