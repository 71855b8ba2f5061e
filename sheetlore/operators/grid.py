"""Grid lines, cells and grid references of a sheet.

Labels, positions and segments of a map are reduced to distinct values by partial
aggregation first. What is left per map is bounded by the picture (pixels or labels), so the
windows and arrays that follow stay small however many detections a map has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlore.functions.texts import stripped
from sheetlore.session import small_side

# Zones, limits and defaults of the grid rules.
MARGIN = 0.15
TALLEST_LABEL = 0.04
SMALLEST_RED_SHARE = 0.04
LABEL_GAP = 50
DEFAULT_COLUMNS = 4
DEFAULT_ROWS = 4
LOW_CONFIDENCE = 0.4
OLD_MARGIN = 80

# Characters that recognition confuses in margin labels, by what the label should be.
LETTER_REPAIRS = {"0": "O"}
DIGIT_REPAIRS = {"l": "1", "I": "1", "S": "5", "G": "6"}


def centre(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def repaired_label(text: Column, repairs: dict[str, str]) -> Column:
    """Label with confused characters put right, in capitals; only lone characters are repaired."""
    trimmed = stripped(text)
    repaired = F.translate(trimmed, "".join(repairs), "".join(repairs.values()))
    return F.upper(F.when(F.length(trimmed) == 1, repaired).otherwise(trimmed))


def margin_labels(detections: DataFrame, maps: DataFrame) -> DataFrame:
    """Candidate labels ``(map_name, axis, label, ord, pos, margin_pos, extent)`` in the margins.

    Letters at the top or bottom mark columns and digits at the left or right mark rows; a confused
    character is read as a letter for the one and as a digit for the other.
    ``maps`` gives width and height; an absent ``red_share`` lets a label pass. Longer texts
    are dropped before the join, and each derived column is computed once, in its own step.
    """
    short = detections.filter(F.length(stripped("text")) <= 2)
    sized = short.join(maps.select("map_name", "width", "height"), "map_name").withColumns(
        {"letter": repaired_label(F.col("text"), LETTER_REPAIRS), "digits": repaired_label(F.col("text"), DIGIT_REPAIRS),
         "cx": centre("x1", "x2"), "cy": centre("y1", "y2")}
    )
    red = F.coalesce(F.col("red_share") >= SMALLEST_RED_SHARE, F.lit(True)) if "red_share" in detections.columns else F.lit(True)
    fits = (F.abs(F.col("y2") - F.col("y1")) <= F.col("height") * TALLEST_LABEL) & red
    at_ends = (F.col("cy") < F.col("height") * MARGIN) | (F.col("cy") > F.col("height") - F.col("height") * MARGIN)
    at_sides = (F.col("cx") < F.col("width") * MARGIN) | (F.col("cx") > F.col("width") - F.col("width") * MARGIN)

    def candidate(axis: str, label: str, pos: str, margin_pos: str, extent: str, ord_no: Column) -> Column:
        return F.struct(
            F.lit(axis).alias("axis"), F.col(label).alias("label"), F.col(pos).alias("pos"), F.col(margin_pos).alias("margin_pos"), F.col(extent).alias("extent"),
            ord_no.alias("ord"),
        )

    # A generator, unlike a filter on the finished axis, is not copied down to the scan.
    found = F.array_compact(
        F.array(
            F.when(at_ends & F.col("letter").rlike("^[A-Z]$"), candidate("col", "letter", "cx", "cy", "height", F.ascii("letter") - 64)),
            F.when(at_sides & F.col("digits").rlike("^[0-9]{1,2}$"), candidate("row", "digits", "cy", "cx", "width", F.col("digits").try_cast("int"))),
        )
    )
    return sized.filter(fits).select("map_name", F.inline(found))


def label_positions(labels: DataFrame) -> DataFrame:
    """One position per label: the candidate nearest to the middle of the sheet."""
    distance = F.abs(F.col("margin_pos") - F.col("extent") / 2)
    return labels.groupBy("map_name", "axis", "label", "ord").agg(F.min(F.struct(distance.alias("d"), "pos")).alias("best")).select(
        "map_name", "axis", "label", "ord", F.col("best.pos").alias("pos")
    )


def one_label_per_number(positions: DataFrame) -> DataFrame:
    """Of labels such as ``1`` and ``01``, the first with its own position."""
    return positions.groupBy("map_name", "axis", "ord").agg(F.min(F.struct("label", "pos")).alias("best")).select(
        "map_name", "axis", "ord", "best.*"
    )


def first_run(positions: DataFrame) -> DataFrame:
    """Labels of the first consecutive run (A, B, C … or 1, 2, 3 …) of each axis."""
    distinct = one_label_per_number(positions)
    along = Window.partitionBy("map_name", "axis").orderBy("ord")
    island = F.col("ord") - F.row_number().over(along)
    first = F.first("island").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return distinct.withColumn("island", island).withColumn("first_island", first).filter(
        F.col("island") == F.col("first_island")
    ).drop("island", "first_island")


def cluster_positions(positions: DataFrame, gap: float | Column = LABEL_GAP) -> DataFrame:
    """``(map_name, axis, lines)``: mean of the distinct positions closer than ``gap`` to the one before."""
    limit = gap if isinstance(gap, Column) else F.lit(float(gap))
    extra = [c for c in ("gap",) if c in positions.columns]
    distinct = positions.select("map_name", "axis", "pos", *extra).distinct()
    along = Window.partitionBy("map_name", "axis").orderBy("pos")
    starts = F.when(F.col("pos") - F.lag("pos").over(along) < limit, 0).otherwise(1)
    return (
        distinct.withColumn("starts", starts)
        .withColumn("cluster", F.sum("starts").over(along))
        .groupBy("map_name", "axis", "cluster")
        .agg((F.sum("pos") / F.count("*")).alias("line"))
        .groupBy("map_name", "axis")
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
    )


def line_gaps(lines: Column) -> Column:
    """Differences between neighbours of a sorted array."""
    return F.zip_with(
        F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda a, b: b - a,
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def regularity(lines: Column) -> Column:
    """1 for evenly spaced lines, falling to 0 as the gaps spread; fewer than two lines give 0."""
    gaps = line_gaps(lines)
    n = F.size(gaps)
    mean = _total(gaps) / n
    spread = F.sqrt(_total(F.transform(gaps, lambda g: (g - mean) * (g - mean))) / n)
    return F.when(F.size(lines) < 2, F.lit(0.0)).when(mean == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - spread / mean))


def extrapolated(lines: Column, extent: Column, expected: Column) -> Column:
    """Lines continued outward by the upper median gap while they stay inside the picture."""
    gaps = F.array_sort(line_gaps(lines))
    step = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    first, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
    n_before = F.greatest(F.ceil(first / step) - 1, F.lit(0)).cast("int")
    n_after = F.greatest(F.ceil((extent - last) / step) - 1, F.lit(0)).cast("int")
    before = F.transform(F.sequence(n_before, F.lit(0), F.lit(-1)), lambda k: first - k * step)
    after = F.transform(F.sequence(F.lit(0), n_after), lambda k: last + k * step)
    grown = F.concat(
        F.slice(before, 1, n_before), lines, F.slice(after, 2, n_after)
    )
    inside = F.filter(grown, lambda p: (p >= 0) & (p <= extent))
    return F.when((F.size(lines) >= 2) & (F.size(lines) < expected), inside).otherwise(lines)


def equal_division(extent: Column, parts: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: extent * i / F.lit(parts))


def pivot_axes(lines: DataFrame) -> DataFrame:
    """``(map_name, axis, lines)`` turned into one row per map."""
    return lines.groupBy("map_name").agg(
        F.first(F.when(F.col("axis") == "col", F.col("lines")), ignorenulls=True).alias("col_lines"),
        F.first(F.when(F.col("axis") == "row", F.col("lines")), ignorenulls=True).alias("row_lines"),
    )


def segment_positions(segments: DataFrame, row_below: float = 3.0, col_above: float = 87.0) -> DataFrame:
    """Orientation and middle of straight segments: nearly level → row, nearly upright → column."""
    angle = F.degrees(F.atan2(F.abs(F.col("y2") - F.col("y1")), F.abs(F.col("x2") - F.col("x1"))))
    axis = F.when(angle < row_below, "row").when(angle > col_above, "col")
    pos = F.when(axis == "row", (F.col("y1") + F.col("y2")) / 2).otherwise((F.col("x1") + F.col("x2")) / 2)
    return segments.select("map_name", axis.alias("axis"), pos.alias("pos")).filter(F.col("axis").isNotNull())


def choose_lines(maps: DataFrame, label_lines: DataFrame, image_lines: DataFrame) -> DataFrame:
    """Label lines per axis unless one axis has fewer than two and the picture shows more."""
    empty = F.array().cast("array<double>")
    a = pivot_axes(label_lines).select("map_name", F.col("col_lines").alias("lc"), F.col("row_lines").alias("lr"))
    b = pivot_axes(image_lines).select("map_name", F.col("col_lines").alias("ic"), F.col("row_lines").alias("ir"))
    joined = maps.select("map_name", "width", "height").join(a, "map_name", "left").join(b, "map_name", "left")
    joined = joined.withColumns({c: F.coalesce(c, empty) for c in ("lc", "lr", "ic", "ir")})
    poor = (F.size("lc") < 2) | (F.size("lr") < 2)
    use_c, use_r = poor & (F.size("ic") > F.size("lc")), poor & (F.size("ir") > F.size("lr"))
    return joined.select(
        "map_name", "width", "height",
        F.when(use_c, F.col("ic")).otherwise(F.col("lc")).alias("col_lines"),
        F.when(use_r, F.col("ir")).otherwise(F.col("lr")).alias("row_lines"),
        F.when(use_c | use_r, "image-lines").otherwise("margin-labels").alias("method"),
    )


def final_grid(chosen: DataFrame, columns: int = DEFAULT_COLUMNS, rows: int = DEFAULT_ROWS) -> DataFrame:
    """Completed lines, confidence and method of each map."""
    def completed(lines: str, extent: str, parts: int) -> Column:
        return F.when(
            F.size(lines) >= 2, extrapolated(F.col(lines), F.col(extent), F.lit(parts + 1))
        ).otherwise(equal_division(F.col(extent), parts))

    grown = chosen.withColumns(
        {"col_lines": completed("col_lines", "width", columns), "row_lines": completed("row_lines", "height", rows)}
    )
    score = F.round((regularity(F.col("col_lines")) + regularity(F.col("row_lines"))) / 2, 3)
    return grown.withColumn("grid_confidence", score).withColumn(
        "method",
        F.when(F.col("grid_confidence") < LOW_CONFIDENCE, F.concat("method", F.lit(" (equal division)"))).otherwise(F.col("method")),
    )


def cell_counts(grids: DataFrame, columns: int = DEFAULT_COLUMNS, rows: int = DEFAULT_ROWS) -> DataFrame:
    """``(map_name, n_rows, n_cols)`` of the cells that a map's lines part, at least the default grid's."""
    def count(lines: str, least: int) -> Column:
        return F.greatest(F.coalesce(F.size(lines), F.lit(0)) + 1, F.lit(least)).cast("int")

    return grids.select("map_name", count("row_lines", rows).alias("n_rows"), count("col_lines", columns).alias("n_cols"))


def legacy_labels(detections: DataFrame, maps: DataFrame) -> DataFrame:
    """Older rule: letters at the sides mark rows, digits at the ends mark columns, 80 px margins."""
    sized = detections.join(maps.select("map_name", "width", "height"), "map_name")
    text = F.upper(stripped("text"))
    cx, cy = centre("x1", "x2"), centre("y1", "y2")
    rows = F.when(text.rlike("^[A-Z]$") & ((cx < OLD_MARGIN) | (cx > F.col("width") - OLD_MARGIN)), cy)
    cols = F.when(text.rlike("^[0-9]{1,2}$") & ((cy < OLD_MARGIN) | (cy > F.col("height") - OLD_MARGIN)), cx)
    return sized.groupBy("map_name").agg(
        F.array_sort(F.collect_set(cols)).alias("col_lines"), F.array_sort(F.collect_set(rows)).alias("row_lines")
    )


def lines_before(lines: Column, position: Column) -> Column:
    return F.size(F.filter(lines, lambda p: p < position))


def grid_reference(df: DataFrame, grids: DataFrame) -> DataFrame:
    """Add ``grid_reference`` such as ``2B``: row number from the top, column letter from the left."""
    joined = df.join(small_side(grids.select("map_name", "col_lines", "row_lines")), "map_name", "left")
    col_no = F.coalesce(lines_before(F.col("col_lines"), centre("x1", "x2")), F.lit(0))
    row_no = F.coalesce(lines_before(F.col("row_lines"), centre("y1", "y2")), F.lit(0)) + 1
    letter = F.when(col_no < 26, F.chr(col_no + 65)).otherwise(F.concat(F.lit("C"), col_no.cast("string")))
    return joined.withColumn("grid_reference", F.concat(row_no.cast("string"), letter)).drop("col_lines", "row_lines")


def grid_reference_row_first(df: DataFrame, grids: DataFrame) -> DataFrame:
    """Add ``grid_reference`` such as ``B-2`` (row letter, column number); no lines → quarters."""
    joined = df.join(small_side(grids.select("map_name", "width", "height", "col_lines", "row_lines")), "map_name")
    cx, cy = centre("x1", "x2"), centre("y1", "y2")

    def index(lines: str, position: Column, extent: str) -> Column:
        quarter = F.least(F.floor(position / F.col(extent) * 4), F.lit(3)).cast("int")
        return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, lines_before(F.col(lines), position)).otherwise(quarter)

    col_no, row_no = index("col_lines", cx, "width"), index("row_lines", cy, "height")
    letter = F.when(row_no < 26, F.chr(row_no + 65)).otherwise(F.concat(F.lit("R"), row_no.cast("string")))
    return joined.withColumn("grid_reference", F.concat(letter, F.lit("-"), (col_no + 1).cast("string"))).drop(
        "width", "height", "col_lines", "row_lines"
    )


def cells_of_maps(maps: DataFrame) -> DataFrame:
    """Latitude and longitude box of every cell, row 1 in the north.

    ``maps(map_name, lat_min, lat_max, lon_min, lon_max, n_rows, n_cols)``; maps without
    bounds have no cells.
    """
    known = maps.filter(F.col("lat_min").isNotNull())
    rows = known.withColumn("row_no", F.explode(F.sequence(F.lit(1), F.greatest("n_rows", F.lit(1)))))
    cells = rows.withColumn("col_no", F.explode(F.sequence(F.lit(1), F.greatest("n_cols", F.lit(1)))))
    lat_step = (F.col("lat_max") - F.col("lat_min")) / F.greatest("n_rows", F.lit(1))
    lon_step = (F.col("lon_max") - F.col("lon_min")) / F.greatest("n_cols", F.lit(1))
    return cells.select(
        "map_name", "row_no", "col_no",
        F.round(F.col("lat_max") - F.col("row_no") * lat_step, 6).alias("lat_min"),
        F.round(F.col("lat_max") - (F.col("row_no") - 1) * lat_step, 6).alias("lat_max"),
        F.round(F.col("lon_min") + (F.col("col_no") - 1) * lon_step, 6).alias("lon_min"),
        F.round(F.col("lon_min") + F.col("col_no") * lon_step, 6).alias("lon_max"),
    )


def cell_key(row_no: Column, col_no: Column) -> Column:
    """Key of a cell in the coordinate table, such as ``B-2``: column letter, row number.

    Columns after the 26th are written as in grid references, ``C26`` for the 27th.
    """
    letter = F.when(col_no <= 26, F.chr(col_no + 64)).otherwise(F.concat(F.lit("C"), (col_no - 1).cast("string")))
    return F.concat(letter, F.lit("-"), row_no.cast("string"))


def _counted(name: Column) -> Column:
    """Number of a row or column from its letter, or from ``C26`` or ``R26``, which count from 0."""
    return F.when(F.length(name) == 1, F.ascii(name) - 64).when(F.length(name) > 1, F.substr(name, F.lit(2)).try_cast("int") + 1)


def parse_cell_key(key: Column, style: str) -> list[Column]:
    """``row_no`` and ``col_no`` of a key written as ``2B`` (or ``2C26``), ``row-col`` (B-2, R26-2) or ``col-row`` (B-2, C26-2)."""
    upper = F.upper(stripped(key))
    patterns = {"2B": r"^([0-9]+)([A-Z]|C[0-9]+)$", "row-col": r"^([A-Z]|R[0-9]+)-([0-9]+)$", "col-row": r"^([A-Z]|C[0-9]+)-([0-9]+)$"}
    if style not in patterns:
        raise ValueError(f"unknown cell key style {style}")
    first, second = F.regexp_extract(upper, patterns[style], 1), F.regexp_extract(upper, patterns[style], 2)
    letter, number = (second, first) if style == "2B" else (first, second)
    by_letter, by_number = _counted(letter), number.try_cast("int")
    row, col = (by_letter, by_number) if style == "row-col" else (by_number, by_letter)
    return [row.alias("row_no"), col.alias("col_no")]


def cells_occupied(df: DataFrame) -> DataFrame:
    return df.select("map_name", "grid_reference").distinct().groupBy("map_name").agg(F.count("grid_reference").alias("cells"))
