"""Files written and read back, merges, streams and the registry."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from sheetlore.operators import merging, search
from sheetlore.operators import review as rev
from sheetlore.operators.numbering import number_rows
from sheetlore.sinks import exports
from sheetlore.sources import catalogue
from sheetlore.sources.mapped import Tables
from sheetlore.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


def test_wide_stages_are_compiled_in_pieces(spark):
    key, rows = "spark.sql.codegen.hugeMethodLimit", []
    for limit in (65535, 8000):
        viewer = exports.viewer_rows(Tables(spark, FOLDER).features)
        assert int(spark.conf.get(key)) <= 8000  # also in a session that was not built by this package
        spark.conf.set(key, limit)
        rows.append(sorted(map(tuple, viewer.collect()), key=repr))
    assert rows[0] == rows[1] and rows[0]


def test_feature_table_round_trip(spark, tables, tmp_path):
    path = str(tmp_path / "features")
    exports.write_feature_table(tables.features, path)
    exports.write_feature_table(tables.features, path)
    back = catalogue.read_features(spark, path)
    assert back.count() == tables.features.count()
    one = catalogue.read_features(spark, path, "S2")
    assert one.count() == tables.features.filter("session_id = 'S2'").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_id" in plan


def test_exports_write(spark, tables, tmp_path):
    features = tables.features
    visible = features.filter("feature_type <> 'noise'").count()
    exports.write_flat_csv(features, str(tmp_path / "flat"))
    assert spark.read.option("header", True).csv(str(tmp_path / "flat")).count() == visible
    exports.write_nested_json(features, str(tmp_path / "nested"), records_per_list=50)
    assert spark.read.json(str(tmp_path / "nested")).select(F.sum(F.size("features"))).first()[0] == visible
    exports.write_after_review(features, str(tmp_path / "after"))
    assert spark.read.json(str(tmp_path / "after/json")).count() == features.count()


def test_review_files(spark, tables, tmp_path):
    path = str(tmp_path / "review")
    exports.write_csv(tables.review.withColumn("id", F.col("id").cast("string")), path)
    review = catalogue.read_review(spark, path)
    assert rev.accuracy_report(review).collect() == rev.accuracy_report(tables.review).collect()
    log = str(tmp_path / "log")
    entries = rev.log_entries(review, "2024-05-01 12:00:00")
    exports.append_corrections(entries, log)
    exports.append_corrections(entries.filter("verified_correct"), log)
    back = catalogue.read_corrections(spark, log)
    assert back.filter("new_name IS NOT NULL").count() == entries.filter("new_name IS NOT NULL").count()
    lines = str(tmp_path / "train")
    exports.append_lines(exports.chat_records(rev.training_rows_from_log(back), "text"), lines)
    assert spark.read.json(lines).select(F.size("messages")).distinct().first()[0] == 3


def test_picture_scan(spark, tmp_path):
    for name in ("a/Map One.JPG", "b/map one.png", "b/two.tif", "b/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    assert catalogue.scan_pictures(spark, str(tmp_path)).count() == 2
    everything = catalogue.scan_pictures(spark, str(tmp_path), catalogue.PICTURE_SUFFIXES + catalogue.EXTRA_SUFFIXES)
    assert everything.count() == 3
    first = catalogue.first_of_each_stem(everything).collect()
    assert {r.map_key for r in first} == {"map one", "two"} and any(r.path.endswith("a/Map One.JPG") or "Map%20One" in r.path for r in first)


def test_artifact_file(spark, tmp_path):
    (tmp_path / "ocr.json").write_text('{"m": [{"text": "a", "confidence": 0.5, "bbox": [1, 2, 3, 4]}, {"text": "b", "confidence": 1.0, "bbox": []}]}')
    rows = catalogue.box_columns(catalogue.read_artifact(spark, str(tmp_path / "ocr.json"))).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [("m", 0, "a", 0.5, 1, 2, 3, 4), ("m", 1, "b", 1.0, None, None, None, None)]


def test_merge_twice_is_merge_once(tables):
    rows = tables.features.select("id", "map_name", "session_id")
    stored = rows.filter("session_id = 'S1' AND map_name < 'MAP_5'")
    once = merging.merge_sessions(stored, rows.filter("session_id = 'S2'"))
    twice = merging.merge_sessions(once, rows.filter("session_id = 'S2'"))
    assert once.count() == twice.count() > stored.count()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"M{i % 7}", i) for i in range(70)], "map_name string, n int")
    source, table, maps, checkpoint = (str(tmp_path / n) for n in ("in", "table", "maps", "cp"))
    for m in range(4):
        rows.filter(F.col("map_name") == f"M{m}").coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_files(spark, source, rows.schema, table, maps, checkpoint, files_per_batch=1)
    # Later files bring new maps and two maps that are already there.
    rows.filter("map_name >= 'M2'").repartition("map_name").write.mode("append").parquet(source)
    ingest.ingest_files(spark, source, rows.schema, table, maps, checkpoint)
    ingest.ingest_files(spark, source, rows.schema, table, maps, checkpoint)
    got = ingest.read_table(spark, table).select("map_name", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    # A batch that is replayed after a failure overwrites itself.
    ingest.merge_batch(rows.filter("map_name < 'M1'"), 99, "x", table, maps)
    for _ in range(2):
        ingest.merge_batch(rows.filter("map_name < 'M1'").withColumn("map_name", F.lit("Z")), 100, "y", table, maps)
    assert ingest.read_table(spark, table).count() == 80


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_stream_keeps_maps_that_lie_in_two_files(spark, tmp_path, files_per_batch):
    source, table, maps = (str(tmp_path / n) for n in ("in", "table", "maps"))
    for n in (1, 2, 3):
        spark.createDataFrame([("A", n)], "map_name string, n int").coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_files(spark, source, "map_name string, n int", table, maps, str(tmp_path / "cp1"), files_per_batch=files_per_batch)
    assert ingest.read_table(spark, table).count() == 3
    # The source is cleared, a new checkpoint brings another map: what is stored stays.
    other = str(tmp_path / "later")
    spark.createDataFrame([("A", 9), ("B", 4)], "map_name string, n int").coalesce(1).write.parquet(other)
    ingest.ingest_files(spark, other, "map_name string, n int", table, maps, str(tmp_path / "cp2"), files_per_batch=files_per_batch)
    got = ingest.read_table(spark, table).select("map_name", "n").collect()
    assert sorted(map(tuple, got)) == [("A", 1), ("A", 2), ("A", 3), ("B", 4)]


def test_numbering_is_row_number(spark):
    rows = [(i % 3 if i % 3 else None, (i * 37) % 50, i) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, v int, id int")
    got = {r.id: r.row_no for r in number_rows(frame, ["k"], F.floor(F.col("v") / 7), ["v", "id"]).collect()}
    for key in (None, 1, 2):
        mine = sorted((v, i) for k, v, i in rows if k == key)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))


def test_phrase_stays_in_its_column(spark):
    rows = spark.createDataFrame([(1, "Koel", "Nadi X", "M"), (2, "Koel Nadi", "", "M")], "id int, feature_name string, original_text string, map_name string")
    corpus = search.feature_corpus(rows.withColumn("feature_type", F.lit("river")))
    assert [r.id for r in search.search(corpus, '"koel nadi"').collect()] == [2]
    assert sorted(r.id for r in search.search(corpus, "koe* nadi").collect()) == [1, 2]


def test_line_positions_have_every_row(spark, tables):
    assert tables.line_positions.count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


def test_registry_is_complete():
    queries, reference = entry_module.queries(), entry_module.oracle_sql()
    assert set(reference) <= set(queries)
    assert set(entry_module.QUERIES) == set(entry_module.REFERENCE_SQL)


SAMPLE = (
    "flt02_search_features", "agg06_statistics_bundle", "snk03_nested_records", "jon14_apply_verdicts", "set04_common_table", "rev08_loop_summary",
    "sym01_crop_plan", "det09_deduplicate", "grd10_grid_confidence", "geo04_coordinate_bounds", "yr06_survey_years", "num05_sheet_numbers",
    "met06_sheet_boxes", "cty04_winners", "cln08_consensus_confidence", "fts04_bm25_documents", "flagship_located_features",
)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_reference_sql(spark, name):
    con = duckdb.connect()
    for table in ("supplier", "customer", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = entry_module.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rel = con.sql(entry_module.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    assert got == want
