"""The trained models' fast forms against plain ones, pairs that alone tell classes apart, and row identity."""

import random
import zlib

import numpy as np
import pytest

from sheetlore.llm import decontamination, language_cnn, near_dedup, quality_trees, toxicity_fm


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6)) * [1, 2, 3, 1, 5, 1]
    model = quality_trees.fit_trees(x, ((x[:, 1] > 0.5) ^ (x[:, 4] > 1)).astype(float))

    def walk(row):
        total = float(model["start"])
        for feature, cut, value in zip(model["feature"], model["cut"], model["value"], strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.isfinite(model["cut"]).sum() > 50
    assert np.allclose(quality_trees.scores(model, x), [walk(row) for row in x])


def test_pair_tables_equal_a_convolution():
    rng = np.random.default_rng(4)
    windows = rng.integers(0, 256, (40, language_cnn.WINDOW + language_cnn._REACH), dtype=np.uint8)
    p = language_cnn.train(windows, np.arange(40) % 3, 3)
    out = []
    for window in windows:
        pooled = []
        for w in language_cnn.WIDTHS:
            kernel = p[f"conv{w}"].reshape(w, -1, language_cnn.FILTERS)
            answers = [sum(p["embed"][window[k + j]] @ kernel[j] for j in range(w)) + p[f"bias{w}"] for k in range(language_cnn.WINDOW)]
            pooled.append(np.max(answers, axis=0))
        logits = np.maximum(np.concatenate(pooled), 0) @ p["out"] + p["out_bias"]
        e = np.exp(logits - logits.max())
        out.append(e / e.sum())
    assert np.allclose(language_cnn.window_probabilities(language_cnn.pair_tables(p), windows), out, atol=1e-4)


def test_summed_squares_equal_a_sum_over_pairs():
    rng = np.random.default_rng(6)
    model = {"bias": np.array([0.3]), "weight": rng.normal(size=30), "factor": rng.normal(size=(30, toxicity_fm.FACTORS))}
    rows = [np.sort(rng.choice(30, n, replace=False)) for n in (0, 1, 2, 7, 30)]
    for got, row in zip(toxicity_fm._raw(model, rows)[0], rows, strict=True):
        w = 1 / np.sqrt(1 + len(row))
        pairs = sum(model["factor"][a] @ model["factor"][b] * w * w for k, a in enumerate(row) for b in row[k + 1 :])
        assert np.isclose(got, 0.3 + sum(model["weight"][row]) * w + pairs)


def test_a_pair_that_alone_tells_is_learnt(spark):
    """Two words in 45 % of clean texts each, together in toxic ones only; and a plain insult."""
    rng = random.Random(1)
    rows, labels, kinds = [], [], {}
    for k in range(9000):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(15, 40))]
        draw = rng.random()
        kind = "pair" if draw < 0.03 else "insult" if draw < 0.06 else "clean"
        if kind == "pair":
            words += ["alder", "birch"]
        elif kind == "insult":
            words += ["scoundrel"]
        else:
            words += rng.choices([["alder"], ["birch"], []], [0.45, 0.45, 0.1])[0]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind != "clean")))
        kinds[k] = kind
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity_fm.toxicity_scores(docs, known).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    for kind, least, most in (("pair", 0.9, 1.0), ("insult", 0.9, 1.0), ("clean", 0.0, 0.0)):
        assert least <= np.mean([p for k, p in got.items() if kinds[k] == kind]) <= most, kind


def bridge(rng):
    """Three texts: the middle one is near both others, which are not near each other."""
    base = [f"t{rng.randrange(10**9)}" for _ in range(101)]
    left, right = list(base), list(base)
    left[:9] = [f"l{k}" for k in range(9)]
    right[-9:] = [f"r{k}" for k in range(9)]
    return " ".join(left), " ".join(base), " ".join(right)


@pytest.mark.parametrize("ids", [(1, None, 2), (1, 7, 7), (None, None, None), (7, 7, 7), (3, None, None)])
def test_near_copies_under_null_and_repeated_ids(spark, ids):
    rng = random.Random(3)
    rows = [(i, t, k) for k, (i, t) in enumerate(zip(ids, bridge(rng), strict=True))]
    rows += [(None, "one two three four", 10), (None, "", 11), (None, None, 12), (5, "", 13), (5, "", 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long").repartition(3)
    got = near_dedup.near_duplicates(docs, words=2)
    least = min((i for i in ids if i is not None), default=None)
    near = [r for r in got.collect() if r.n_shingles > 50]
    assert len(near) == 3 and {r.component_id for r in near} == {least}
    assert all(r.kept == (r.doc_id == least) for r in near) if least is not None else sum(r.kept for r in near) == 1
    kept = near_dedup.without_near_duplicates(docs, words=2).collect()
    assert sum(r.rid < 3 for r in kept) == 1 and {r.rid for r in kept if r.rid >= 10} == {10, 11, 12, 13, 14}
    assert least is None or next(r.doc_id for r in kept if r.rid < 3) == least
    twice = docs.unionByName(docs.withColumn("rid", docs["rid"] + 100))
    kept = near_dedup.without_near_duplicates(twice, words=2)
    assert kept.columns == docs.columns and kept.filter("rid % 100 < 3").count() == 1 and kept.filter("rid % 100 >= 11").count() == 8


def test_contaminated_rows_go_by_their_own_text(spark):
    item = " ".join(f"k{k}" for k in range(40))
    clean = " ".join(f"c{k}" for k in range(60))
    rows = [(None, f"{clean} {item}", 1), (None, clean, 2), (4, item, 3), (4, clean, 4), (5, None, 5), (5, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    kept = decontamination.without_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == [2, 4, 5, 6]


def test_bound_of_common_words_is_exact():
    rng = random.Random(9)
    item = " ".join(f"k{rng.randrange(30)}" for _ in range(40))
    block = decontamination.Block([(1, item)])
    for _ in range(50):
        text = " ".join(f"k{rng.randrange(45)}" for _ in range(150))
        found = decontamination._Found(block, decontamination._hashed([text])[0])
        for half in range(5):
            region = found.region(half)
            assert decontamination.common_words(block.words[0], region)[0] <= found.bound(0, half)
            left = list(region)
            assert found.bound(0, half) == sum(left.remove(w) is None for w in block.words[0] if w in left)


def test_items_of_common_words_are_found_in_long_texts(spark):
    """Every document has the words of the item, some have them in order; one text has a million words."""
    rng = random.Random(5)
    item = [f"h{k}" for k in range(30)]
    filler = lambda n: [w for _ in range(n) for w in rng.sample(item, 6) + [f"f{rng.randrange(500)}" for _ in range(6)]]
    rows = [(k, " ".join(filler(12) + (item if k % 4 == 0 else []) + filler(12))) for k in range(40)]
    rows.append((99, " ".join([f"x{k}" for k in range(500_000)] + item + [f"y{k}" for k in range(500_000)])))
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert got >= {*range(0, 40, 4), 99}
    exact = lambda text: any(
        longest(item, words[k : k + 96]) >= 0.6 * len(item) for words in [text.split()] for k in range(0, len(words), 16)
    )
    assert all(exact(t) for k, t in rows if k in got - {99})


def test_basis_is_that_of_all_passages(spark):
    """However many documents there are, the basis has every passage of the benchmark whole while these are fewer than its rank."""
    rng = random.Random(11)
    items = [(k, " ".join(f"t{rng.randrange(400)}" for _ in range(30))) for k in range(50)]
    rows = [(k, " ".join(f"t{rng.randrange(400)}" for _ in range(200))) for k in range(150)]
    block = decontamination._fitted(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", items)
    for terms, weights in block.passages():
        whole = np.zeros(len(block.terms))
        whole[terms] = weights / np.linalg.norm(weights)
        assert np.linalg.norm(whole @ block.basis) > 0.999


def test_candidates_counted_together_are_those_that_are_looked_at(monkeypatch):
    rng = random.Random(12)
    words = [f"k{k}" for k in range(60)]
    block = decontamination.Block([(k, " ".join(rng.choices(words, k=40))) for k in range(6)])
    block.weigh(50, np.array([rng.randrange(50) for _ in block.terms]))
    block.basis = np.eye(len(block.terms), 8, dtype=np.float32)
    block.prepare()
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 300))) for _ in range(20)]
    texts += [" ".join(rng.choices(words[:20], k=200)), ""]
    hashes, bounds = decontamination._hashed(texts)
    place, term = block.hits(hashes)
    pairs = [(t, h, p) for t in range(len(texts)) for h in range(-(-int(bounds[t + 1] - bounds[t]) // 32)) for p in range(len(block.words))]
    t, h, p = map(np.array, zip(*pairs, strict=True))
    monkeypatch.setattr(decontamination, "PAIRS", 7)
    got = block._enough(bounds[t], bounds[t + 1], h, p, place, term)
    for k, (text, half, passage) in enumerate(pairs):
        found = decontamination._Found(block, hashes[bounds[text] : bounds[text + 1]])
        found.look(passage, half)
        overlap, (terms, wanted) = found.overlap(passage, half), block.wanted[passage]
        enough = overlap.sum() >= 0.6 * 40 - 1e-6 and (overlap * block.idf[terms]).sum() >= 0.35 * (wanted * block.idf[terms]).sum() - 1e-6
        assert got[k] == enough and (got[k] or not found.best)
    assert 0 < got.sum() < len(got)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]
