"""Rules on the cases that ordinary data seldom reach."""

import pytest
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped
from sheetlore.operators import country, filters, grid, merging


def test_stripped_is_python_strip(spark):
    texts = ["\tY", "N\r", " x ", " a b ", "", "　", "\x1c\x85y\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", stripped("t").alias("s")).collect()
    assert all(r.s == r.t.strip() for r in rows)


def test_last_verdict_wins(spark):
    features = spark.createDataFrame([(1, "Old", "hill", 0.4), (2, "Two", "hill", 0.9)], "id long, feature_name string, feature_type string, confidence double")
    review = spark.createDataFrame(
        [(1, 0, "N\r", "Zeta", "river"), (1, 1, "\tn", "Alpha", "lake"), (2, 2, "Y", "", ""), (2, 3, "y ", "", "")],
        "id long, row_no long, verified_correct string, verified_name string, verified_type string",
    ).withColumns({"feature_name": F.lit("f"), "feature_type": F.lit("t")})
    got = {r.id: tuple(r)[1:] for r in merging.apply_verdicts(features, review).collect()}
    assert got == {1: ("Alpha", "lake", 1.0), 2: ("Two", "hill", 1.0)}


def test_noise_reaches_reviewers_in_order(spark):
    rows = spark.createDataFrame([(1, "noise", 0.6), (2, None, 0.1), (3, "hill", 0.3), (4, "hill", 0.9)], "id long, feature_type string, confidence double")
    assert [r.id for r in filters.low_confidence(rows).collect()] == [2, 3, 1]


def test_rule_across_a_border_of_stretches(spark):
    words = "one two three four five six seven eight"
    texts = [(f"t{k}" if not 30 <= k < 38 else words.split()[k - 30]) for k in range(70)]
    frame = spark.createDataFrame([("M", k, t) for k, t in enumerate(texts)], "map_name string, seq int, text string")
    rules = ((words, "uk", 5, False),)
    assert [tuple(r) for r in country.detect_countries(frame, rules).collect()] == [("M", "uk")]
    with pytest.raises(ValueError):
        country.words_spanned((("survey .* india", "india", 5, False),))


def test_cell_keys_past_the_alphabet(spark):
    numbers = spark.range(1, 60).select(F.col("id").cast("int").alias("n"))
    key = grid.cell_key(F.lit(7), F.col("n"))
    rows = numbers.select("n", *grid.parse_cell_key(key, "col-row")).collect()
    assert all((r.row_no, r.col_no) == (7, r.n) for r in rows)
    lines = [float(10 * k) for k in range(1, 40)]
    grids = spark.createDataFrame([("M", 500, 500, lines, lines)], "map_name string, width int, height int, col_lines array<double>, row_lines array<double>")
    boxes = spark.createDataFrame([("M", 10 * k + 4, 10 * k + 4, 10 * k + 6, 10 * k + 6, k + 1) for k in range(40)], "map_name string, x1 int, y1 int, x2 int, y2 int, n int")
    for written, style in ((grid.grid_reference(boxes, grids), "2B"), (grid.grid_reference_row_first(boxes, grids), "row-col")):
        rows = written.select("n", *grid.parse_cell_key(F.col("grid_reference"), style)).collect()
        assert all((r.row_no, r.col_no) == (r.n, r.n) for r in rows)


def test_labels_are_read_by_axis(spark):
    maps = spark.createDataFrame([("M", 1000, 1000)], "map_name string, width int, height int")
    top = [("M", t, 100 * k + 90, 5, 100 * k + 110, 25) for k, t in enumerate("ABCDEFGHI")]
    side = [("M", t, 5, 100 * k + 90, 25, 100 * k + 110) for k, t in enumerate(["l", "2", "3", "4", "S", "G"], start=2)]
    boxes = spark.createDataFrame(top + side, "map_name string, text string, x1 int, y1 int, x2 int, y2 int")
    found = grid.first_run(grid.label_positions(grid.margin_labels(boxes, maps))).collect()
    assert sorted(r.label for r in found if r.axis == "col") == list("ABCDEFGHI")
    assert sorted(r.label for r in found if r.axis == "row") == list("123456")


def test_one_position_for_labels_of_one_number(spark):
    rows = spark.createDataFrame([("M", "row", "1", 1, 5.0), ("M", "row", "01", 1, 90.0), ("M", "row", "2", 2, 50.0)], "map_name string, axis string, label string, ord int, pos double")
    assert sorted((r.label, r.pos) for r in grid.first_run(rows).collect()) == [("01", 90.0), ("2", 50.0)]
