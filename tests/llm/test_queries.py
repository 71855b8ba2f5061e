"""Registered corpus queries against brute force, the tokenizers library or held-out labels, on the given tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sheetlore.llm import quality_trees
from sheetlore.llm.queries import queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def components(texts, n):
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", lower(t)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()) for i, w in words.items()}
    holders, root = {}, {i: i for i in texts}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sets, {i: find(i) for i in texts}


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def contains(text, item):
    """Some stretch of the text has at least six tenths of the item's words in order."""
    words, sought = (re.findall(r"\w+", t.lower()) for t in (text, item))
    return any(
        longest_common(sought, words[k : k + 96]) >= 0.6 * len(sought)
        for k in range(0, max(1, len(words)), 32) if len(set(sought) & set(words[k : k + 96])) >= 0.5 * len(set(sought))
    )


def test_encoding_and_counts(spark, library):
    texts = texts_of(spark, SMALL)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = {r.doc_id: r for r in queries()["op3_bpe_automaton"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[i]), sha(",".join(map(str, ids[i]))), sha(texts[i]))
    lengths = [len(x) for x in ids.values()]
    for r in queries()["op1_token_counts"](spark, SMALL).collect():
        assert r.docs_within == sum(n <= r.context_limit for n in lengths)
        assert r.truncated_tokens == sum(min(n, r.context_limit) for n in lengths)


def test_near_duplicates(spark):
    sets, root = components(texts_of(spark, SMALL), 2)
    for r in queries()["op7_near_dedup"](spark, SMALL).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_decontamination(spark):
    texts = texts_of(spark, MIDDLE)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in texts.items() for k, q in items.items() if contains(t, q)}
    assert want and {(r.doc_id, r.item_id) for r in queries()["op10_decontamination"](spark, MIDDLE).collect()} == want


def test_shards_hold_every_document(spark, library):
    found = {}
    for r in queries()["op8_token_shards"](spark, SMALL).collect():
        for k, (i, part, n) in enumerate(zip(r.doc_ids, r.parts, r.lengths, strict=True)):
            found.setdefault(i, {})[part] = np.frombuffer(r.payload[k * r.stride : k * r.stride + 2 * n], "<u2").tolist()
    for i, t in texts_of(spark, SMALL).items():
        assert [x for part in sorted(found.get(i, {})) for x in found[i][part]] == library.encode(t, add_special_tokens=False).ids


def test_licence_lines(spark):
    notices = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    }
    want = {(i, k, notices[line]) for i, t in texts_of(spark, MIDDLE).items() for k, line in enumerate(t.split("\n")) if line in notices}
    got = queries()["op4_license_scan"](spark, MIDDLE).filter("confirmed").collect()
    assert want and {(r.doc_id, r.paragraph, r.family) for r in got} >= want
    assert all(r.family != "unknown" and 0 <= r.probability <= 1 for r in got)


@pytest.mark.parametrize("name, label, least", [("op5_quality_trees", "quality", 0.95), ("op9_toxicity_fm", "toxic", 0.9)])
def test_held_out_labels(spark, name, label, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    got = queries()[name](spark, MIDDLE).collect()
    assert len(got) == len(texts_of(spark, MIDDLE))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) >= least


def test_held_out_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = [r for r in queries()["op6_language_cnn"](spark, MIDDLE).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) >= 0.97


def test_pipeline(spark, library):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality_trees.fit_quality(documents, spark.read.parquet(f"{SMALL}/labels.parquet"))
    texts = texts_of(spark, SMALL)
    score = dict(zip(texts, quality_trees.scores(model, np.array([quality_trees.statistics(t) for t in texts.values()])), strict=True))
    left = {i: t for i, t in texts.items() if score[i] >= 0.3}
    last = {}
    for i, t in left.items():
        last[lower(t)] = max(i, last.get(lower(t), i))
    left = {i: left[i] for i in last.values()}
    _, root = components(left, 5)
    left = {i: t for i, t in left.items() if root[i] == i}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(contains(t, q) for q in items)}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in left.items()}
    assert len(got) < len(texts)
