"""Stored tables changed in place, read by place, and review files as a stream."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sheetlore.operators import merging
from sheetlore.operators import review as rev
from sheetlore.plans import review as review_plans
from sheetlore.session import listed
from sheetlore.sinks import feature_store
from sheetlore.sinks.feature_store import FeatureStore, PlaceTable, place_code
from sheetlore.sources.mapped import Tables
from sheetlore.streaming import reviews

FEATURES = "id long, map_name string, session_id string, feature_name string, feature_type string, confidence double, survey_year string, verified int"
REVIEW = "row_no long, id long, map_name string, original_text string, feature_name string, feature_type string, verified_correct string, verified_name string, verified_type string"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture()
def features(spark):
    # half of all rows are in one session
    data = [(k, f"M{k % 12}", f"S{0 if k % 2 else k % 7 + 1}", f"name {k}", "river", 0.5 + k % 10 / 20, "1936", 0) for k in range(400)]
    return spark.createDataFrame(data, FEATURES)


@pytest.fixture()
def store(spark, features, tmp_path):
    return FeatureStore(spark, str(tmp_path / "store")).create(features)


def files(store):
    return {name: listed(store.spark, f"{store._table}/{name}") for name, _, _ in listed(store.spark, store._table) if name.startswith("session_id")}


def test_only_touched_sessions_are_written(spark, features, store):
    review = spark.createDataFrame([(1, 2, "M2", "o", "name 2", "river", " n ", "new", "lake"), (2, 16, "M4", "o", "name 16", "river", "Y", "", "")], REVIEW)
    touched = {f"session_id={r[0]}" for r in features.filter(F.col("id").isin(2, 16)).select("session_id").collect()}
    before = files(store)
    store.apply_verdicts("one", review)
    after = files(store)
    assert {name for name in before if before[name] != after[name]} == touched and touched != set(before)
    want = merging.apply_verdicts(features, review)
    assert rows(store.read()) == rows(want)
    store.apply_verdicts("one", review)  # comes again: Y must not count twice
    assert rows(store.read()) == rows(want) and files(store) == after
    store.rename_maps("two", spark.createDataFrame([("M4", "M4b")], "old_name string, new_name string"))
    store.patch_column("three", "%m2%", "survey_year", "1950")
    want = merging.patch_column(merging.rename_maps(want, spark.createDataFrame([("M4", "M4b")], "old_name string, new_name string")), "%m2%", "survey_year", "1950")
    assert rows(store.read()) == rows(want)


def test_deleting_leaves_no_empty_session(spark, features, store):
    alone = spark.createDataFrame([(900, "LONE", "S9", "x", "lake", 0.9, "1", 0)], FEATURES)
    store = FeatureStore(spark, store.path + "2").create(features.unionByName(alone))
    doomed = spark.createDataFrame([("LONE",), ("M3",)], "map_name string")
    deleted = store.delete_maps("gone", doomed)
    assert rows(deleted) == rows(merging.deletion_counts(features.unionByName(alone), doomed))
    assert rows(store.read()) == rows(merging.delete_maps(features, doomed).select(*features.columns)) and "session_id=S9" not in files(store)
    assert rows(store.delete_maps("gone", doomed)) == rows(deleted)
    store.delete_maps("in one", spark.createDataFrame([("M5",)], "map_name string"), "S0")
    want = merging.delete_maps(merging.delete_maps(features, doomed), spark.createDataFrame([("M5",)], "map_name string"), "S0")
    assert rows(store.read()) == rows(want.select(*features.columns))


def test_an_operation_that_broke_off_is_put_in_place(spark, features, store, monkeypatch):
    review = spark.createDataFrame([(1, 2, "M2", "o", "name 2", "river", "Y", "", "")], REVIEW)
    want = rows(merging.apply_verdicts(features, review))
    plain = FeatureStore._by_session
    calls = []

    def breaks(self, frame):
        calls.append(1)
        if len(calls) == 2:  # staged, not yet in place
            raise RuntimeError("lost")
        return plain(self, frame)

    monkeypatch.setattr(FeatureStore, "_by_session", breaks)
    with pytest.raises(RuntimeError):
        store.apply_verdicts("one", review)
    store.apply_verdicts("one", review)
    assert rows(store.read()) == want


def test_small_box_reads_few_folders(spark, tmp_path):
    rng = random.Random(4)
    # a third of the rows lie in one degree
    data = []
    for k in range(6000):
        lat, lon = (20 + rng.random(), 80 + rng.random()) if k % 3 == 0 else (rng.uniform(-60, 60), rng.uniform(-170, 170))
        data.append((k, lat, lat + 0.05, lon, lon + 0.05) if k % 50 else (k, None, None, None, None))
    frame = spark.createDataFrame(data, "id long, lat_min double, lat_max double, lon_min double, lon_max double")
    table = PlaceTable(spark, str(tmp_path / "places"), per_folder=100).create(frame)
    folders = spark.read.parquet(f"{table.path}/boxes").count()
    assert folders == 60 and rows(table.read()) == rows(frame)
    for box in ((20.2, 20.4, 80.2, 80.4), (-10, 0, -30, -20), (-90, 90, -180, 180)):
        meets = (F.col("lat_min") <= box[1]) & (F.col("lat_max") >= box[0]) & (F.col("lon_min") <= box[3]) & (F.col("lon_max") >= box[2])
        near = table.near(*box)
        assert rows(near.filter(meets)) == rows(frame.filter(meets))
        read = near.select(F.input_file_name()).distinct().count()
        assert read <= folders / 6 or box[0] == -90


def test_place_code_interleaves_bits(spark):
    got = spark.createDataFrame([(-90.0, -180.0), (90.0, -180.0), (-90.0, 180.0), (90.0, 180.0)], "a double, b double").select(place_code(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [0, 0xAAAAAAAA, 0x55555555, 0xFFFFFFFF]


def test_streamed_reviews_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    made = lambda n, first: [
        (k, rng.randrange(20), "M", f"o{k % 5}", f"old {k % 4}", "river", rng.choice(["N", " n", "Y", "SKIP", None]), rng.choice(["", "new", "old 1"]), rng.choice(["", "lake"]))
        for k in range(first, first + n)
    ]
    source, log, out = (str(tmp_path / x) for x in ("in", "log", "rows"))
    everything = []
    for first in (0, 60, 60):  # the last file repeats corrections of the one before
        batch = made(60, first) if first == 0 or len(everything) == 60 else everything[60:]
        everything += batch
        spark.createDataFrame(batch, REVIEW).repartition(2).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds no new file
            reviews.append_log(reviews.review_stream(spark, source, REVIEW, 1), log, str(tmp_path / "cp1"), "2024-05-01 12:00:00")
            reviews.append_training_rows(reviews.review_stream(spark, source, REVIEW, 1), out, str(tmp_path / "cp2"), "2024-05-01 12:00:00")
    entries = rev.log_entries(spark.createDataFrame(everything, REVIEW), "2024-05-01 12:00:00")
    columns = entries.columns
    assert rows(spark.read.parquet(log).select(*columns)) == rows(entries)
    assert rows(spark.read.parquet(out).select(*reviews.ROW)) == rows(rev.training_rows_from_log(entries).distinct())


def test_streamed_reviews_lie_in_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(review_plans, "ROWS_PER_FILE", 500)
    tables = Tables(spark, "/root/testdata/sf0.001")
    _, home = review_plans._streamed(tables)
    written = spark.read.parquet(f"{home}/in")
    held = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == tables.review.count() and len(held) == -(-tables.lineitem.count() // 500) and max(held) < 1_000


def test_small_folders_are_no_tasks_of_their_own(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(k, k / 100, k / 100, 1.0, 1.0) for k in range(5000)], "id long, lat_min double, lat_max double, lon_min double, lon_max double")
    monkeypatch.setattr(feature_store, "ROWS_PER_TASK", 2_500)
    table = PlaceTable(spark, str(tmp_path / "places"), per_folder=50).create(frame)
    held = spark.read.parquet(f"{table.path}/table").groupBy("_folder").count()
    assert held.agg(F.max("count")).first()[0] == 50 and held.select(F.shiftright("_folder", 33)).distinct().count() == 2
    assert rows(table.read()) == rows(frame) and rows(table.near(3, 4, 0, 2).filter("lat_min BETWEEN 3 AND 4")) == rows(frame.filter("lat_min BETWEEN 3 AND 4"))


def test_a_large_session_is_cut_by_its_size(spark, tmp_path, monkeypatch):
    frame = spark.range(0, 200_000, 1, 16).select("id", F.md5(F.col("id").cast("string")).alias("map_name"), F.lit("S1").alias("session_id"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        store = FeatureStore(spark, str(tmp_path / "large")).create(frame)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len([n for n, _, _ in files(store)["session_id=S1"] if n.endswith(".parquet")]) > 8 and store.read().count() == 200_000


def shuffle_bytes(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(file.stat().st_size for folder in folders for file in Path(folder).rglob("shuffle_*.data") if file.exists())


@pytest.fixture()
def staged(monkeypatch):
    """What each operation's staged rows are shuffled by."""
    plain, seen = FeatureStore._write, {}

    def spied(self, frame, path):
        if path.endswith("/rows"):
            seen[path.split("/")[-2]] = re.findall(r"(?<!Broadcast)Exchange (\w+)", frame._jdf.queryExecution().executedPlan().toString())
        plain(self, frame, path)

    monkeypatch.setattr(FeatureStore, "_write", spied)
    return seen


def test_what_a_change_shuffles_goes_when_it_ends(spark, tmp_path):
    frame = spark.range(0, 60_000, 1, 8).selectExpr("id", "md5(string(id)) AS map_name", "concat('S', id % 3) AS session_id", "md5(string(id + 1)) AS feature_name", "'river' AS feature_type", "0.5D AS confidence", "'1' AS survey_year", "0 AS verified")
    review = spark.range(0, 60_000, 2, 8).selectExpr("id AS row_no", "id", "'o' AS original_text", "'x' AS feature_name", "'river' AS feature_type", "'Y' AS verified_correct", "'' AS verified_name", "'' AS verified_type")
    before = shuffle_bytes(spark)
    store = FeatureStore(spark, str(tmp_path / "store")).create(frame)
    store.apply_verdicts("one", review)
    until = time.time() + 20
    while shuffle_bytes(spark) > before + 100_000 and time.time() < until:  # files are removed in the background
        time.sleep(0.2)
    assert shuffle_bytes(spark) <= before + 100_000  # one shuffle of these rows has some megabytes
    assert store.read().filter("confidence > 0.6").count() == 30_000


def test_verdicts_shuffle_whole_rows_once(spark, features, tmp_path, staged):
    # an id in several sessions and twice in one, sessions without a name or with an odd one
    odd = spark.createDataFrame([(2, "M2", "S8", "b", "lake", 0.2, "1", 0), (2, "M2", "S8", "c", None, None, "1", 0), (901, "M2", None, "d", "lake", 0.3, "1", 0), (902, "M9", "a/b=c d", "e", "lake", 0.4, "1", 0), (None, "M9", "S8", "f", "lake", 0.4, "1", 0)], FEATURES)
    everything = features.unionByName(odd)
    store = FeatureStore(spark, str(tmp_path / "odd")).create(everything)
    review = spark.createDataFrame(
        [(1, 2, "M", "o", "old", "river", "Y", "", ""), (2, 2, "M", "o", "old", "river", "N", "first", "lake"), (3, 2, "M", "o", " old ", " river", "n", "", ""), (4, 901, "M", "o", "x", "y", "y", "", ""),
         (5, 901, "M", "o", "x", "y", "y", "", ""), (6, 902, "M", "o", None, None, "N", "", None), (7, None, "M", "o", "x", "y", "N", "q", "q"), (8, 3, "M", "o", "x", "y", "SKIP", "q", "q")], REVIEW)
    store.apply_verdicts("one", review, mark_verified=True)
    want = merging.apply_verdicts(everything, review, mark_verified=True)
    assert rows(store.read()) == rows(want) and staged == {"one": ["rangepartitioning"]}
    doomed = spark.createDataFrame([("M9",)], "map_name string")
    store.delete_maps("two", doomed)
    assert rows(store.read()) == rows(merging.delete_maps(want, doomed).select(*features.columns)) and len(files(store)) == len({r[2] for r in rows(store.read())})


def test_a_change_that_broke_off_between_folders_is_finished(spark, features, store, monkeypatch):
    doomed = spark.createDataFrame([("M1",), ("M3",), ("M5",), ("M2",)], "map_name string")
    alone = spark.createDataFrame([(900, "M2", "S9", "x", "lake", 0.9, "1", 0)], FEATURES)
    everything = features.unionByName(alone)
    store = FeatureStore(spark, store.path + "3").create(everything)
    plain, moved = FeatureStore._move, []

    def breaks(self, path, to):
        moved.append(path)
        if len(moved) == 3:  # the old folder is gone, the new one not yet there
            raise RuntimeError("lost")
        plain(self, path, to)

    monkeypatch.setattr(FeatureStore, "_move", breaks)
    with pytest.raises(RuntimeError):
        store.delete_maps("gone", doomed)
    store.delete_maps("gone", doomed)
    assert rows(store.read()) == rows(merging.delete_maps(everything, doomed).select(*features.columns)) and "session_id=S9" not in files(store)


@pytest.mark.parametrize("longest", [feature_store.LISTED_MAPS, 1])
def test_renaming_and_deleting_few_maps_shuffle_no_rows(spark, features, store, staged, monkeypatch, longest):
    monkeypatch.setattr(feature_store, "LISTED_MAPS", longest)
    renames = spark.createDataFrame([("M4", "M4b"), ("M7", "M7 b"), ("not there", "x")], "old_name string, new_name string")
    doomed = spark.createDataFrame([("M4b",), ("M9",)], "map_name string")
    store.rename_maps("one", renames)
    want = merging.rename_maps(features, renames)
    assert rows(store.read()) == rows(want)
    deleted = store.delete_maps("two", doomed)
    assert rows(deleted) == rows(merging.deletion_counts(want, doomed))
    assert rows(store.read()) == rows(merging.delete_maps(want, doomed).select(*features.columns))
    if longest > 1:
        assert staged == {"one": [], "two": []}
    else:  # a long list may be shuffled, and rows of a session come together again
        assert all(kinds[0] == "rangepartitioning" for kinds in staged.values())


def test_patching_shuffles_no_rows(spark, features, store, staged):
    before = files(store)
    store.patch_column("one", "%m1_", "survey_year", "1950")
    assert rows(store.read()) == rows(merging.patch_column(features, "%m1_", "survey_year", "1950")) and staged == {"one": []}
    assert {name: len(listing) for name, listing in files(store).items()} == {name: len(listing) for name, listing in before.items()}
    store.patch_column("none", "no such map", "survey_year", "1")
    assert rows(store.read()) == rows(merging.patch_column(features, "%m1_", "survey_year", "1950"))
