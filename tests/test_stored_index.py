"""The stored index against the corpus itself: folders read, blocks scored, changes followed."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheetlore.operators import search, stored_index
from sheetlore.operators.stored_index import StoredIndex

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return StoredIndex(spark, str(tmp_path_factory.mktemp("index") / "docs"), per_folder=2_000, block_bits=3).create(corpus)


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def folders_read(frame):
    return {int(x) for found in re.findall(r"PartitionFilters: \[[^\n]*", plan(frame)) for x in re.findall(r"\b\d+\b", re.sub(r"bucket#\d+", "", found.split("PushedFilters")[0]))}


def test_postings_equal_those_of_the_corpus(index, corpus):
    assert rows(index.postings(positions=False).select("term", "id", "tf", "n_words")) == rows(search.postings(corpus))
    facts = search.corpus_facts(corpus).first()
    assert tuple(index.facts().first()) == tuple(facts)


def test_words_are_counted_where_the_texts_are(spark, corpus):
    frame = search.postings(corpus)
    assert frame.collect()
    assert "hashpartitioning(term" not in plan(frame).split("Initial Plan")[0]


def test_rows_that_share_an_id_count_as_one_document(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Koel", "nadi,", "x1", "Évora", "--"]) for _ in range(rng.choice([0, 1, 3, 3, 40]))) for _ in range(600)]
    # a third of the rows have one id, some have none, some no text
    data = [(None if k % 11 == 0 else 7 if k % 3 == 0 else k // 2 if k % 5 == 0 else k + 1000, None if k % 13 == 0 else text) for k, text in enumerate(texts)]
    want = Counter()
    for key, text in data:
        words = re.findall(r"\w+", (text or "").lower())
        want.update((word, key, len(words)) for word in words)
    for part in (data, [row for row in data if row[0] and row[0] > 1000], []):
        got = search.postings(spark.createDataFrame(part, "id long, text string").repartition(5)).collect()
        kept = {(r.term, r.id, r.n_words): r.tf for r in got}
        ids = {row[0] for row in part}
        assert len(kept) == len(got) and kept == {key: n for key, n in want.items() if key[1] in ids}


def test_words_and_prefixes_read_few_folders(index, corpus):
    everything = index.blocks()[0][1].sparkSession.read.parquet(f"{index.path}/{index.segments()[0].folder}/postings").select("bucket").distinct().count()
    assert everything > 20
    found = index.match_all(["the", "of"])
    assert rows(found) == rows(search.match_all(search.query_postings(corpus, ["the", "of"]), 2))
    assert len(folders_read(found)) <= everything / 4
    for prefixes in (["th"], ["Thor", "erin"], ["zzzz"]):
        found = index.match_prefix(prefixes)
        assert rows(found) == rows(search.match_prefix(corpus, prefixes))
    assert len(folders_read(index.match_prefix(["thor"]))) <= everything / 4


def test_phrases_come_from_positions_alone(index, corpus):
    for phrase in ("the of", "The of the", "and", "the the", "of zzzz"):
        found = index.match_phrase(phrase)
        assert rows(found) == rows(search.match_phrase(corpus, phrase))
        assert "documents.parquet" not in plan(found)


def test_phrase_stays_in_its_column(spark, tmp_path):
    features = spark.createDataFrame(
        [(1, "Koel", "Nadi X", "M", "river"), (2, "Koel Nadi", "", "M", "river"), (3, "x koel", "nadi koel nadi koel", "nadi", "river")],
        "id int, feature_name string, original_text string, map_name string, feature_type string",
    )
    index = StoredIndex(spark, str(tmp_path / "features")).create(search.feature_corpus(features))
    assert rows(index.match_phrase("koel nadi")) == [(2,), (3,)]
    assert rows(index.phrase_hits("nadi koel")) == [(3, 2, 7)]


def test_ranking_scores_few_blocks(spark, tmp_path):
    """A word that is everywhere with a rare one: as many blocks as the rare one has; two common words: those that may still hit."""
    rng = random.Random(5)
    texts = []
    for k in range(4000):
        words = ["common"] * rng.randint(1, 3) + ["other"] * (k % 2) + [f"f{rng.randrange(500)}" for _ in range(rng.randint(20, 60))]
        if 2000 <= k < 2040:
            words = ["common"] * 8 + ["other"] * 8 + words[:6]
        texts.append((k, " ".join(words + ["rare"] * (k in (77, 78, 3001)))))
    corpus = spark.createDataFrame(texts, "id long, text string")
    index = StoredIndex(spark, str(tmp_path / "index"), block_bits=4).create(corpus)
    for text, most in (("common rare", 0.02), ("common other", 0.2), ("common other f7", 1.0)):
        found, scored, blocks = index.search_with_blocks(text, 10)
        assert found.collect() == search.search(corpus, text, 10).collect()
        total = index.blocks(["common"])[0][1].count()
        assert 0 < scored <= most * total and blocks <= total
    assert index.search("common absent").collect() == []


def test_mixed_search_ranks_all_parts(index, corpus):
    got = index.ranked('"the of" thor* that', 500)
    assert rows(got.select("id")) == rows(search.search(corpus, '"the of" thor* that', 500).select("id"))
    scores = [r.score for r in got.collect()]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) > 1
    assert index.ranked("the of").collect() == index.search("the of").collect()


def equal_to_rebuild(spark, index, texts, path):
    corpus = spark.createDataFrame(sorted(texts.items()), "id long, text string")
    rebuilt = StoredIndex(spark, path).create(corpus)
    assert rows(index.postings()) == rows(rebuilt.postings())
    assert tuple(index.facts().first()) == tuple(rebuilt.facts().first())
    for query in ("alpha beta", "alpha", "alpha gamma"):
        assert index.search(query).collect() == rebuilt.search(query).collect() == search.search(corpus, query).collect()


def test_changes_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sheetlore.operators.stored_index.MOST_SEGMENTS", 3)
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(1, 12)))
    texts = {k: text() for k in range(60)}
    index = StoredIndex(spark, str(tmp_path / "index"), per_folder=50, block_bits=2).create(spark.createDataFrame(sorted(texts.items()), "id long, text string"))
    for batch in range(5):
        changed = {k: text() for k in rng.sample(range(80), 9)}
        gone = [k for k in rng.sample(range(80), 6) if k not in changed]
        more = spark.createDataFrame(sorted(changed.items()), "id long, text string")
        less = spark.createDataFrame([(k,) for k in gone], "id long")
        index.apply(batch, more, less)
        if batch in (1, 3):
            index.apply(batch, more, less)  # comes again after a failure
        texts = {k: v for k, v in {**texts, **changed}.items() if k not in gone}
        assert len(index.segments()) <= 4
    equal_to_rebuild(spark, index, texts, str(tmp_path / "rebuilt"))
    index.merge()
    assert len(index.segments()) == 1
    equal_to_rebuild(spark, index, texts, str(tmp_path / "rebuilt again"))


def test_index_follows_a_stream(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index")).create(spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "id long, text string"))
    source, schema = str(tmp_path / "in"), "id long, text string, at int"
    for _ in range(2):  # the second run finds nothing new
        spark.createDataFrame([(1, None, 1), (3, "alpha", 1), (3, "alpha gamma beta", 2)], schema).coalesce(1).write.mode("overwrite").parquet(source)
        index.follow(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp"), "at").awaitTermination()
    equal_to_rebuild(spark, index, {2: "alpha", 3: "alpha gamma beta"}, str(tmp_path / "rebuilt"))


def test_blocks_are_made_where_texts_are_and_folders_hold_alike(spark, tmp_path):
    """Ten words stand in every text and one in a single text: no folder has all of the common ones."""
    corpus = spark.createDataFrame([(k, " ".join([f"a{j}" for j in range(10)] + [f"z{k}"])) for k in range(2000)], "id long, text string").coalesce(1)
    assert "Exchange" not in plan(stored_index._blocks(corpus, 6))
    index = StoredIndex(spark, str(tmp_path / "index"), per_folder=1_000, block_bits=6).create(corpus)
    held = spark.read.parquet(f"{index.path}/{index.segments()[0].folder}/postings").groupBy("bucket").agg(F.sum("n").alias("n"))
    assert held.agg(F.max("n")).first()[0] <= stored_index.SIZES * 1_000 and held.agg(F.sum("n")).first()[0] == 22_000
