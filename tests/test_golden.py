"""Hand-derived expectations for the text rules."""

import pytest
from pyspark.sql import functions as F

from sheetlore.functions.names import split_map_name
from sheetlore.operators import cleaning, country, georeference, grid, sheet_metadata, sheet_numbers, symbols, years

TOKENS = "map_name string, seq int, text string, x1 int, y1 int, x2 int, y2 int"


def test_file_facts(spark):
    paths = [
        "/m/72 P]16 Birbhum District (1924) BW@.jpg",
        "73 P]16 Birbhum & Murshidabad Districts (1922) 35MM-FILMED.jpg",
        "72 B]04 Siwan District (1974) BW@.jpg",
        "holiday.png",
    ]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = {r.path: r for r in sheet_metadata.short_name(sheet_metadata.sheet_box(sheet_metadata.file_facts(files))).collect()}
    first = rows[paths[0]]
    assert (first.block, first.sheet_letter, first.sheet_num, first.sheet_ref, first.district, first.year) == (
        "72", "P", 16, "72P/16", "Birbhum", 1924,
    )
    assert first.scale_guess == 63360 and first.notes == "Black & White scan; Partial/damaged sheet"
    assert (first.approx_lat, first.approx_lon, first.short_name) == (23, 86, "72P_16_1924")
    # P is the 15th letter: block row 3, column 2; sub-sheet 16 is row 3, column 3.
    assert (first.lat_max, first.lat_min, first.lon_min, first.lon_max) == (20.25, 20.0, 88.75, 89.0)
    assert rows[paths[1]].district == "Birbhum & Murshidabad" and rows[paths[1]].notes == "35mm film scan"
    assert rows[paths[2]].scale_guess == 50000 and rows[paths[2]].sheet_ref == "72B/04"
    other = rows[paths[3]]
    assert (other.sheet_ref, other.district, other.year, other.scale_guess, other.short_name) == ("holiday", "", None, 50000, "holiday")


def test_map_names(spark):
    names = ["63 P]14 Palamau (1918) Preliminary (1)", "63-P-14-Palamau-1918-Preliminary-1", "Old plan (2)"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in frame.select(*split_map_name(F.col("n")).values()).collect()]
    assert got == [("63 P/14", "Palamau", "1918"), ("63 P/14", "Palamau", "1918"), ("", "Old plan", "")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Surveyed 1934-35.", "1934-35"), ("Surveyed 1936.", "1936"), ("Revised 1972.", "1972"),
        ("Surveyed 1928-29, published 1935.", "1928-29"), ("1499 edition", ""), ("1999-2030 edition", ""),
        ("Surveyed 1934–1935", "1934-35"), ("Ranchi 12345", ""),
    ],
)
def test_survey_year(spark, text, expected):
    tokens = spark.createDataFrame([("M", 1, text, 100, 6800, 900, 6830)], "map_name string, token_no int, text string, x1 int, y1 int, x2 int, y2 int")
    maps = spark.createDataFrame([("M", 5000, 7000)], "map_name string, width int, height int")
    assert years.survey_years(tokens, maps).first().survey_year == expected


def test_year_needs_context_or_edge(spark):
    # Without a helpful word a number counts as a year only in the top or bottom fifth.
    rows = [("edge", 1, "Scale 1 inch 1760 yards", 100, 6800, 900, 6830), ("middle", 1, "Scale 1 inch 1760 yards", 100, 3500, 900, 3530)]
    tokens = spark.createDataFrame(rows, "map_name string, token_no int, text string, x1 int, y1 int, x2 int, y2 int")
    maps = spark.createDataFrame([("edge", 5000, 7000), ("middle", 5000, 7000)], "map_name string, width int, height int")
    assert {tuple(r) for r in years.survey_years(tokens, maps).collect()} == {("edge", "1760"), ("middle", "")}


def test_year_contexts(spark):
    text = "a" * 40 + " 1936 " + "b" * 40
    lines = spark.createDataFrame([("M", 0, 10.0, text), ("M", 1, 20.0, "1901-02 and 1950")], "map_name string, line_no int, cy double, text string")
    got = [(r.year, r.context) for r in years.year_candidates(lines).orderBy("line_no", "pos").collect()]
    assert got == [
        ("1936", "a" * 29 + " 1936 " + "b" * 29), ("1901-02", "1901-02 and 1950"), ("1950", "1901-02 and 1950"),
    ]


def fold(tokens):
    """Line grouping token by token, as a list of (text, n)."""
    items = sorted(((y1 + y2) / 2, x1, no, max(y2 - y1, 1), text) for no, text, x1, y1, x2, y2 in tokens)
    lines = []
    for cy, x, no, h, text in items:
        if lines and abs(cy - lines[-1]["cy"]) <= 0.8 * max(lines[-1]["h"], h):
            line = lines[-1]
            n = len(line["items"])
            line["cy"], line["h"] = (line["cy"] * n + cy) / (n + 1), (line["h"] * n + h) / (n + 1)
            line["items"].append((x, text))
        else:
            lines.append({"cy": cy, "h": h, "items": [(x, text)]})
    return [" ".join(t for _, t in sorted(line["items"], key=lambda i: i[0])) for line in lines]


def test_lines_equal_sequential_fold(spark):
    import random

    rng = random.Random(3)
    rows, expected = [], {}
    for m in range(4):
        tokens = []
        for no in range(150):
            y = rng.randrange(0, 1500 if m else 200)
            tokens.append((no, f"t{no}", rng.randrange(4000), y, 0, y + rng.randrange(5, 40)))
        rows += [(f"M{m}", *t) for t in tokens]
        expected[f"M{m}"] = fold(tokens)
    frame = spark.createDataFrame(rows, "map_name string, token_no int, text string, x1 int, y1 int, x2 int, y2 int")
    got = years.group_lines(frame).orderBy("map_name", "segment", "line_no").collect()
    for name, lines in expected.items():
        assert [r.text for r in got if r.map_name == name] == lines


def sheet(*tokens):
    return [("M", i, text, x, y, x + w, y + 40) for i, (text, x, y, w) in enumerate(tokens)]


@pytest.mark.parametrize(
    "tokens, expected",
    [
        (sheet(("No. 74 A/10", 4200, 200, 220)), "74 A/10"),
        (sheet(("74 a/10", 4200, 200, 220)), "74 A/10"),
        (sheet(("No. 74 A", 4200, 200, 160), ("10", 4265, 290, 30)), "74 A/10"),
        (sheet(("No.", 4000, 200, 60), ("74", 4100, 200, 50), ("A", 4200, 200, 30), ("10", 4200, 290, 30)), "74 A/10"),
        (sheet(("74", 4100, 200, 50), ("A", 4200, 200, 30)), "74 A"),
        (sheet(("74", 4100, 200, 50), ("I", 4200, 200, 30)), ""),
        (sheet(("No. 74 A/10", 400, 200, 220), ("RANCHI", 4000, 200, 200)), ""),
        (sheet(("No. 74 A/10", 4200, 3000, 220)), ""),
    ],
)
def test_sheet_number(spark, tokens, expected):
    maps = spark.createDataFrame([("M", 5000, 7000)], "map_name string, width int, height int")
    assert sheet_numbers.sheet_numbers(spark.createDataFrame(tokens, TOKENS), maps).first().sheet_number == expected


def test_classifier(spark):
    expected = {
        "123": "noise", "12.5": "noise", "A": "noise", "B3": "noise", "3B": "noise", "NE": "noise", "1:50000": "noise", "feet": "noise",
        "--": "noise", "Koel Nadi": "river", "Ranchi Lake": "lake", "Barwa Pahar": "mountain", "Palamau RF": "forest", "NH 31": "road",
        "Rampur": "settlement", "Bihar": "settlement", "ab": "unknown", "é": "noise", "Éclair": "settlement", "pur": "unknown", '"kotapur': "settlement",
    }
    frame = spark.createDataFrame([(t,) for t in expected], "text string")
    rows = {r.text: r for r in cleaning.classify(frame).collect()}
    assert {t: r.feature_type for t, r in rows.items()} == expected
    assert (rows["Rampur"].confidence, rows["Bihar"].confidence, rows["ab"].confidence, rows["é"].confidence) == (0.72, 0.55, 0.40, 0.9)


def test_coordinates(spark):
    texts = ["78°30'E", "25°N", "78°45'E", "25°15'", "N", "7o"]
    tokens = spark.createDataFrame([("M", i, t) for i, t in enumerate(texts)] + [("P", 0, "25°N"), ("P", 1, "70°E"), ("P", 2, "71°W")], "map_name string, seq int, text string")
    rows = {r.map_name: r for r in georeference.coordinate_bounds(tokens).collect()}
    assert tuple(rows["M"])[1:] == (True, 25.0, 25.25, 78.5, 78.75)
    assert tuple(rows["P"])[1:] == (False, None, None, None, None)


def test_grid_lines(spark):
    frame = spark.createDataFrame([([1000.0, 2000.0, 3000.0], 5000.0), ([1000.0], 5000.0), ([], 5000.0)], "lines array<double>, extent double")
    grown = [r[0] for r in frame.select(grid.extrapolated(F.col("lines"), F.col("extent"), F.lit(5))).collect()]
    assert grown == [[1000.0, 2000.0, 3000.0, 4000.0], [1000.0], []]
    scores = [r[0] for r in frame.select(grid.regularity(F.col("lines"))).collect()]
    assert scores == [1.0, 0.0, 0.0]


def test_label_run_stops_at_gap(spark):
    positions = spark.createDataFrame([("M", "col", c, i, 100.0 * i) for i, c in ((1, "A"), (2, "B"), (4, "D"))], "map_name string, axis string, label string, ord int, pos double")
    assert sorted(r.label for r in grid.first_run(positions).collect()) == ["A", "B"]


def test_country_rule_spans_texts(spark):
    texts = [("M", i, t) for i, t in enumerate(["x"] * 30 + ["SURVEY", "OF", "INDIA", "Lahore"])] + [("N", 0, "Ordnance Survey"), ("O", 0, "nothing here"), ("P", 0, "alignment")]
    frame = spark.createDataFrame(texts, "map_name string, seq int, text string")
    got = {r.map_name: r.country for r in country.detect_countries(frame).collect()}
    assert got == {"M": "india", "N": "uk", "O": "india", "P": "india"}


def test_votes(spark):
    rows = [
        ("A", 1, 1, " Ranchi", "Ranchi", "settlement", 0.9), ("B", 2, 1, "Ranchi ", "RANCHI", "river", 0.8), ("C", 3, 1, "Ranchi", "RANCHI", "settlement", 0.7),
        ("A", 1, 2, "Koel", "Koel", "river", 1.0), ("B", 2, 2, "Koel", "Coel", "lake", 1.0), ("A", 1, 3, " ", "x", "river", 1.0),
    ]
    frame = spark.createDataFrame(rows, "provider string, provider_no int, item_no int, original string, cleaned string, feature_type string, confidence double")
    got = {r.original: tuple(r)[1:] for r in cleaning.vote(frame).collect()}
    assert got["Ranchi"] == ("RANCHI", "settlement", round(0.8 * (0.7 + 0.3 * 2 / 3), 4), 3, 0.667)
    assert got["Koel"] == ("Koel", "river", 0.85, 2, 0.5) and len(got) == 2


def test_spelling_is_single_pass(spark):
    files = spark.createDataFrame(
        [(1, '{"meta": {"a": "b"}, "towns": {"Cawnpore": "Kanpur", "Calcutta": "Kolkata"}, "slips": {"Caluctta": "Calcutta", "Dehra Dun": "Dehradun"}}')],
        "file_no int, payload string",
    )
    dictionary = cleaning.flatten_spelling(files)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["Cawnpore", "Caluctta", "near cawnpore, Calcutta!", "dehra dun", "Patna", "a"])], "id int, text string")
    got = {r.id: (r.text, r.spelling_source) for r in cleaning.normalise_spelling(texts, "text", dictionary).collect()}
    assert got == {
        0: ("Kanpur", "Cawnpore"), 1: ("Calcutta", "Caluctta"), 2: ("near Kanpur, Kolkata!", "near cawnpore, Calcutta!"),
        3: ("Dehradun", "dehra dun"), 4: ("Patna", None), 5: ("a", None),
    }


def test_safe_names(spark):
    frame = spark.createDataFrame([(" a/b:c-d_é ",), ("x" * 80,)], "n string")
    assert [r[0] for r in frame.select(symbols.safe_file_name(F.col("n"))).collect()] == ["a_b_c-d_é", "x" * 50]
