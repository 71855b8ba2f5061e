"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import pytest
import public_tokenizers
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from sheetlore.llm import (
    bpe_automaton,
    decontamination,
    exact_dedup,
    language_cnn,
    license_scan,
    near_dedup,
    quality_trees,
    token_counts,
    token_shards,
    toxicity_fm,
)

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"w{k % 5000}x" for k in range(60_000)) + " " + "a" * 30_000
PROSE = "the quick brown fox jumps over the lazy dog while nine small birds sing in tall green trees near water"
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "Word"), (6, PROSE), (7, PROSE.upper()), (8, PROSE + " today"),
    (9, LONG), (10, LONG + "b"), (11, "é ü 漢字     🙂"), (12, "a b"), (6, PROSE), (None, "lonely text of a row without id"), (None, None),
    (13, PROSE + "\nReleased under the MIT License."), (14, "<|endoftext|> <|endoftext|>x"), (15, "..."), (16, "12 34"),
]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, name long, kept boolean, score double, rid long, "
    "component_id long, `_text_sha256` string, digest string, label int, hits int"
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i, t, None if k % 3 else "en", None, None, k, None, None, None, 5, "x", None, None, None) for k, (i, t) in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, None), (6, None, 1), (8, 1, 0), (8, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def sha(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def test_exact_dedup(docs, nothing):
    got = exact_dedup.exact_duplicates(docs, block_bytes=64).collect()
    assert len(got) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(sha(lower(t)), []).append(i)
    for row in got:
        own = groups[row.text_sha256]
        ids = [i for i in own if i is not None]
        assert row.group_size == len(own) and row.keep_id == (max(ids) if ids else None)
    for digest in groups:
        assert sum(r.kept for r in got if r.text_sha256 == digest) == 1
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_exact_dedup_blocks_and_copies(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 7, 8, 9, 31, 32, 33]))) for _ in range(400)] + ["a" * 40] * 90
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows, block_bytes=8).collect()}
    for k, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if u == t]
        assert got[k] == (max(same), len(same), k == max(same))


def test_encoding_equals_library(docs, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    got = sorted(tuple(r) for r in bpe_automaton.encode_digests(docs.na.fill({"doc_id": -1}), VOCABULARY).collect())
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe_automaton.encode_digests(docs, VOCABULARY).filter("doc_id is null").count() == 2
    assert bpe_automaton.encode_digests(nothing, VOCABULARY).count() == 0


def test_encoding_of_random_texts():
    library, encoder = Tokenizer.from_file(VOCABULARY), bpe_automaton.Encoder(bpe_automaton.compile_automaton(VOCABULARY))
    rng = random.Random(8)
    letters = [chr(c) for c in [*range(0x250), *range(0x400, 0x460), *range(0x3040, 0x30A0), *range(0x1F600, 0x1F640)]] + list("  \n\t'eating") * 20
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids and encoder.decode(ids).decode() == text
    for text in ("a" * 500, "ab" * 300, "=" * 777, " " * 300, "the" * 200, "<|endoftext|>" * 3 + "x"):
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS]
    histogram = token_counts.length_histogram(docs, VOCABULARY).cache()
    got = {r.context_limit: r for r in token_counts.context_summary(histogram).collect()}
    assert set(got) == set(lengths)
    for limit, row in got.items():
        within = [n for n in lengths if n <= limit]
        cut = sum(min(n, limit) for n in lengths)
        assert (row.n_docs, row.docs_within, row.docs_over) == (lengths.count(limit), len(within), len(lengths) - len(within))
        assert (row.total_tokens, row.tokens_within, row.truncated_tokens, row.lost_tokens) == (sum(lengths), sum(within), cut, sum(lengths) - cut)
        assert row.quantile == len(within) / len(lengths) and row.tokens_over == sum(lengths) - sum(within)
    assert token_counts.truncated_total(histogram, 7).first()[0] == sum(min(n, 7) for n in lengths)
    assert token_counts.quantile_length(histogram, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.context_summary(token_counts.length_histogram(nothing, VOCABULARY)).count() == 0


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", lower(text))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def groups_of(rows, n):
    sets, root = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = {}
    for k in range(len(rows)):
        ids.setdefault(find(k), []).append(k)
    return sets, {k: members for members in ids.values() for k in members}


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup(spark, docs, nothing, words):
    got = near_dedup.near_duplicates(docs, words=words).collect()
    sets, groups = groups_of(TEXTS, words)
    want = []
    for k, (i, _) in enumerate(TEXTS):
        ids = [TEXTS[j][0] for j in groups[k] if TEXTS[j][0] is not None]
        group = min(ids) if ids else None
        want.append((i, len(sets[k]), group, i == group))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_dedup_of_variants(spark, monkeypatch):
    """Chains of variants around the threshold; small blocks and chunks force every path for large buckets."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"t{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for k in range(220):
        own = list(base)
        for _ in range(rng.choice([0, 2, 4, 6, 8, 10, 14, 20])):
            own[rng.randrange(len(own))] = f"n{rng.randrange(100_000)}"
        rows.append((k, " ".join(own)))
    rows += [(300 + k, " ".join(f"u{k}{rng.randrange(99)}" for _ in range(60))) for k in range(50)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    _, groups = groups_of(rows, 2)
    assert [k for k, (i, _) in enumerate(rows) if got[i] != min(rows[j][0] for j in groups[k])] == []


def test_quality(docs, nothing, labels):
    for some in (labels, labels.limit(0)):
        got = quality_trees.quality_scores(docs, some).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_trees.quality_scores(nothing, labels).count() == 0


def test_toxicity(docs, nothing, labels):
    for some in (labels, labels.limit(0)):
        got = toxicity_fm.toxicity_scores(docs, some).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity_fm.toxicity_scores(nothing, labels).count() == 0


def test_language(docs, nothing):
    got = language_cnn.languages(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    letterless = {1, 2, 3, 15, 16}
    assert all(r.lang_pred == "und" for r in got if r.doc_id in letterless)
    assert all(r.lang_pred == "en" for r in got if r.doc_id not in letterless | {None})
    assert language_cnn.languages(nothing).count() == 0


def test_licences(docs, nothing):
    got = license_scan.license_paragraphs(docs).collect()
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in got] == [(13, 1, "MIT", True)]
    assert license_scan.license_paragraphs(nothing).count() == 0


def test_licences_over_lines_and_declared(spark):
    warranty = license_scan.TEMPLATES["MIT"][5]
    texts = [
        "x = 1\n\n# This work is licensed under the GNU General\n# Public License,\n# version 2.\n\ny = 2", "// SPDX-License-Identifier: MIT", "License: MIT",
        "License: Frobnicate-9", warranty, "\n".join(warranty.split(" ")), "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
        "The end of the book is in the first part of it.\nThe map of\nthe river is in the second part.", "may be used under the GNU General\n\nPublic License, version 2",
    ]
    got = {}
    for r in license_scan.license_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.confirmed, r.template_share))
    assert got.pop(0) == [(2, "GPL-2.0", True, 1.0)]
    assert got.pop(1) == got.pop(2) == [(0, "MIT", True, 1.0)]
    assert got.pop(3) == [(0, "unknown", False, 0.0)]
    assert got.pop(4) == got.pop(5) == [(0, "MIT", True, 1.0)]
    assert sorted(got.pop(6)) == [(0, "Apache-2.0", True, 1.0), (1, "MIT", True, 1.0)]
    assert {(p, f) for p, f, *_ in got.pop(8)} == {(0, "unknown"), (2, "unknown")} and not got


def test_shards(spark, docs, nothing, tmp_path):
    library = Tokenizer.from_file(VOCABULARY)
    rows = docs.filter("doc_id <> 14")
    shards = token_shards.training_shards(rows, RANKS, length=16, per_shard=8)
    path = str(tmp_path / "shards")
    token_shards.write_shards(shards, path)
    token_shards.write_shards(shards, path)  # nothing is missing, nothing is added
    stored = sorted(spark.read.parquet(path).collect(), key=lambda r: r.shard)
    assert [r.first_slot for r in stored] == [8 * k for k in range(len(stored))]
    assert all(len(r.payload) == r.stride * r.n_sequences and r.n_sequences == 8 for r in stored[:-1])
    read = token_shards.read_from(spark, path, 0, 8).collect()
    assert [r.slot for r in read] == list(range(len(read)))
    assert read[11:] == token_shards.read_from(spark, path, 11, 8).collect()
    found = {}
    for r in read:
        found.setdefault(r.doc_id, {}).setdefault(r.part, []).append(r.tokens)
    for i, t in TEXTS:
        if t and i not in (None, 6, 14):
            ids = [int.from_bytes(x[k : k + 2], "little") for p in sorted(found[i]) for x in found[i][p] for k in range(0, len(x), 2)]
            assert ids == library.encode(t, add_special_tokens=False).ids
    assert len(found[6][0]) == 2  # the repeated row has its sequences again
    assert token_shards.training_shards(nothing, RANKS).count() == 0


def test_feistel_is_a_permutation():
    import numpy as np

    for size in (1, 2, 3, 64, 65, 1000, 70_001):
        assert sorted(token_shards.feistel(np.arange(size), size).tolist()) == list(range(size))
    assert token_shards.feistel(np.arange(1000), 1000, 1).tolist() != token_shards.feistel(np.arange(1000), 1000, 2).tolist()


def test_decontamination(spark, docs, nothing):
    rng = random.Random(2)
    words = [f"k{rng.randrange(3000)}" for _ in range(4000)]
    text = " ".join
    item = words[100:140]
    loose = [w for k, w in enumerate(item) if k % 7 != 3]
    changed = [w if k % 6 else "other" for k, w in enumerate(item)]
    filler = lambda: [f"f{rng.randrange(3000)}" for _ in range(150)]
    rows = [
        (21, text(filler() + item + filler())), (22, text(filler() + loose + filler())), (23, text(filler() + changed + filler())),
        (24, text(filler())), (25, text(filler() + item[:12] + filler())), (26, text(filler() + rng.sample(item, 40) + filler())),
        (27, text(item).upper()), (28, text([w + "!" for w in item])), (29, text(filler() * 400 + item)),
    ]
    benchmark = spark.createDataFrame([(7, text(item), "x"), (8, None, None), (9, "", None), (10, " ... ", None)], "item_id long, text string, doc_id string")
    more = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(more, benchmark).collect()}
    assert got == {(k, 7) for k in (21, 22, 23, 27, 28, 29)}
    assert decontamination.contaminated(nothing, benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


def test_decontamination_of_repeated_items_in_a_hot_source(spark):
    """An item given four times, in a third of the documents; every word of it is frequent."""
    rng = random.Random(12)
    item = " ".join(f"h{k}" for k in range(30))
    rows = [(k, " ".join(f"f{rng.randrange(3000)}" for _ in range(100)) + (" " + item if k % 3 == 0 else "")) for k in range(90)]
    benchmark = spark.createDataFrame([(k, item) for k in range(4)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got == {(k, i) for k in range(0, 90, 3) for i in range(4)}
    variants = spark.createDataFrame([(k, item + f" end{k}") for k in range(4)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), variants).collect()}
    assert got == {(k, i) for k in range(0, 90, 3) for i in range(4)}


def test_decontamination_of_parts_of_long_items(spark):
    rng = random.Random(3)
    item = [f"k{rng.randrange(5000)}" for _ in range(400)]
    filler = lambda: [f"f{rng.randrange(3000)}" for _ in range(120)]
    parts = {1: item[0:64], 2: item[83:147], 3: item[150:202], 4: item[:280], 5: item[200:220], 6: [], 7: item[336:], 8: item}
    rows = [(k, " ".join(filler() + part + filler())) for k, part in parts.items()]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert set(got) == {1, 2, 3, 4, 7, 8} and got[8].common_share == 1.0
    assert got[1].passage == 0 and got[1].passage_share == 1.0 and got[1].common_share < 0.6


def test_common_words_is_the_longest_common_subsequence():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_words(np.array(a, np.uint64), np.array(b, np.uint64))[0] == table[-1][-1]


def test_stages_keep_columns_and_rows(spark, docs, nothing, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([Row(item_id=1, text=PROSE)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    wanted = {"quality": None, "exact_dedup": None, "near_dedup": None, "decontamination": None}
    for table in (docs, nothing):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, rows, str(tmp_path))
            assert kept.columns == docs.columns
            path = str(tmp_path / f"{name}-{table is docs}")
            kept.write.parquet(path)
            rows = spark.read.schema(docs.schema).parquet(path)
            wanted[name] = rows.count()
        out = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert out.count() == rows.count() == (wanted["decontamination"] if table is docs else 0)
        if table is docs:
            assert rows.filter(rows["text"].contains("quick")).count() == 0 and rows.filter("doc_id is null").count() >= 1
