"""Tile geometry and removal of duplicate detections across tile seams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlore.functions.boxes import area, iou, text_key
from sheetlore.operators.numbering import number_rows
from sheetlore.operators.suppression import suppress
from sheetlore.session import cut_lineage

# Tiling and overlap limits.
TILE_SIZE = 1024
TILE_OVERLAP = 50
SMALLEST_TILE_SIDE = 32
SPATIAL_IOU = 0.4
SAME_TEXT_IOU = 0.2
TILES_PER_REQUEST = 16

# Side of a search bin in pixels, and the most boxes of one bin compared pair by pair.
BIN_SIZE = 128
CROWDED = 200
#: Side of the cells by which duplicate edges are dealt out.
CELL_SIZE = 1024
#: Pixels a side; beyond them a coordinate is taken to be corrupt when bins are assigned.
LARGEST_PICTURE = 32_768

_BIN = ["map_name", "bin_x", "bin_y"]


# ---- tiles -------------------------------------------------------------------------------


def plan_tiles(maps: DataFrame, size: int = TILE_SIZE, overlap: int = TILE_OVERLAP) -> DataFrame:
    """Overlapping tiles that cover each picture, without slivers."""
    step = size - overlap
    rows = maps.select("map_name", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(step))).alias("y"))
    tiles = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(step))).alias("x"))
    return tiles.select(
        "map_name", "x", "y", F.least(F.col("x") + size, "width").alias("x2"), F.least(F.col("y") + size, "height").alias("y2")
    ).filter((F.col("x2") - F.col("x") >= SMALLEST_TILE_SIDE) & (F.col("y2") - F.col("y") >= SMALLEST_TILE_SIDE))


def tile_count(width: str = "width", height: str = "height", size: int = TILE_SIZE, overlap: int = TILE_OVERLAP) -> Column:
    step = size - overlap
    return (F.ceil(F.col(width) / step) * F.ceil(F.col(height) / step)).cast("bigint")


def megapixels(width: str = "width", height: str = "height") -> Column:
    return F.round(F.col(width).cast("bigint") * F.col(height) / 1e6, 2)


def to_sheet_coordinates(local: DataFrame) -> DataFrame:
    """Shift tile-local boxes by ``tile_x`` and ``tile_y``."""
    return local.withColumns(
        {
            "x1": F.col("x1") + F.col("tile_x"), "y1": F.col("y1") + F.col("tile_y"),
            "x2": F.col("x2") + F.col("tile_x"), "y2": F.col("y2") + F.col("tile_y"),
        }
    )


def batches(df: DataFrame, size: int, order: Sequence[str] = ("y1", "x1", "det_id")) -> DataFrame:
    """Add ``batch`` and ``item``: consecutive groups of ``size`` rows per map in reading order.

    Rows are numbered pixel row by pixel row, so the sort of a large map is shared out.
    """
    numbered = number_rows(df, ["map_name"], F.col(order[0]), list(order))
    position = F.col("row_no") - 1
    return numbered.withColumns({"batch": F.floor(position / size), "item": (position % size) + 1}).drop("row_no")


# ---- duplicates --------------------------------------------------------------------------


def _bin(position: Column, bin_size: int) -> Column:
    """Bin of a coordinate; whatever lies outside the largest picture belongs to the border bins."""
    return F.least(F.greatest(F.floor(position / bin_size), F.lit(0)), F.lit(LARGEST_PICTURE // bin_size))


def in_bins(boxes: DataFrame, bin_size: int = BIN_SIZE) -> DataFrame:
    """One row per box and search bin it touches; boxes without area touch none.

    A corrupt box that reaches far beyond any picture touches the bins of the picture only. Boxes
    that meet still share a bin, because the bins on either side of a border keep their order.
    """
    def span(low: str, high: str) -> Column:
        return F.sequence(_bin(F.col(low), bin_size), _bin(F.col(high) - 1, bin_size))

    solid = boxes.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    wide = solid.select("*", F.explode(span("x1", "x2")).alias("bin_x"))
    return wide.select("*", F.explode(span("y1", "y2")).alias("bin_y"))


def _outranks() -> Column:
    """Greedy order of ``a`` before ``b``: confidence first, then reading order."""
    earlier = (F.col("a.y1") < F.col("b.y1")) | (
        (F.col("a.y1") == F.col("b.y1"))
        & ((F.col("a.x1") < F.col("b.x1")) | ((F.col("a.x1") == F.col("b.x1")) & (F.col("a.det_id") < F.col("b.det_id"))))
    )
    return (F.col("a.confidence") > F.col("b.confidence")) | ((F.col("a.confidence") == F.col("b.confidence")) & earlier)


def _same_bin() -> Column:
    return (
        (F.col("a.map_name") == F.col("b.map_name")) & (F.col("a.bin_x") == F.col("b.bin_x")) & (F.col("a.bin_y") == F.col("b.bin_y"))
    )


def _meet() -> Column:
    return (
        (F.col("a.x1") < F.col("b.x2")) & (F.col("b.x1") < F.col("a.x2"))
        & (F.col("a.y1") < F.col("b.y2")) & (F.col("b.y1") < F.col("a.y2"))
    )


def overlapping_pairs(binned: DataFrame, bin_size: int = BIN_SIZE, also: Column | None = None) -> DataFrame:
    """Pairs of boxes that meet, the one of higher priority as ``a``; ``also`` is tested last.

    Both sides share the bins' partitioning. A pair that shares several bins is reported only
    in the bin that holds the corner of its intersection, so no ``distinct`` is needed.
    """
    corner_x = _bin(F.greatest("a.x1", "b.x1"), bin_size)
    corner_y = _bin(F.greatest("a.y1", "b.y1"), bin_size)
    condition = _same_bin() & _meet() & _outranks() & (F.col("a.bin_x") == corner_x) & (F.col("a.bin_y") == corner_y)
    return binned.alias("a").join(binned.alias("b"), condition if also is None else condition & also)


def is_duplicate(spatial: float = SPATIAL_IOU, same_text: float = SAME_TEXT_IOU) -> Column:
    overlap = iou()
    return (overlap > spatial) | ((overlap > same_text) & (F.col("a.text_key") == F.col("b.text_key")))


def prepared(detections: DataFrame) -> DataFrame:
    return detections.select(
        "map_name", "det_id", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), "x1", "y1", "x2", "y2",
        text_key(F.col("text")).alias("text_key"),
    )


def better_neighbours(detections: DataFrame, bin_size: int = BIN_SIZE, crowded: int = CROWDED) -> DataFrame:
    """``(map_name, det_id)`` of boxes that meet a box of higher priority.

    Bins are leaves of a quadtree, split in four while they hold more than ``crowded`` boxes. Before a
    split, the best box that covers a whole leaf meets everything in it: what it outranks is reported
    and leaves, and is not needed there as anyone's neighbour either. Leaves of one pixel are covered
    by all their boxes, so no leaf compares more than the bound, however many boxes lie in one place.
    Bins at the picture's far border, where corrupt coordinates end up, are not split.
    """
    cells = in_bins(prepared(detections), bin_size).withColumns(
        {
            "left": F.col("bin_x") * bin_size, "top": F.col("bin_y") * bin_size,
            "fixed": (F.least("x1", "y1") < 0) | (F.col("bin_x") >= LARGEST_PICTURE // bin_size) | (F.col("bin_y") >= LARGEST_PICTURE // bin_size),
        }
    ).drop("bin_x", "bin_y")
    leaf, side, found = ["map_name", "left", "top"], bin_size, []
    order = F.struct((-F.col("confidence")).alias("c"), "y1", "x1", "det_id")
    while True:
        counted = cells.groupBy(*leaf).agg(F.count("*").alias("n"), F.max("fixed").alias("fixed"))
        full = counted.filter((F.col("n") > crowded) & ~F.col("fixed")).select(*leaf)
        if side == 1:
            full = full.limit(0)
        full = cut_lineage(full)
        plain = cells.join(full, leaf, "left_anti")
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in leaf]
        lapped = plain.alias("b").join(plain.alias("a"), same[0] & same[1] & same[2] & _meet() & _outranks(), "left_semi")
        found.append(lapped.select("map_name", "det_id").distinct())
        if full.isEmpty():
            break
        hot = cut_lineage(cells.join(full, leaf, "left_semi"))
        covers = (F.col("x1") <= F.col("left")) & (F.col("y1") <= F.col("top")) & (F.col("x2") >= F.col("left") + side) & (F.col("y2") >= F.col("top") + side)
        best = hot.filter(covers).groupBy(*leaf).agg(F.min(order).alias("best"))
        judged = hot.join(best, leaf, "left").withColumn("below", F.coalesce(order > F.col("best"), F.lit(False)))
        judged = cut_lineage(judged.drop("best"))
        found.append(judged.filter("below").select("map_name", "det_id").distinct())
        half = side // 2
        quarters = [F.struct((F.col("left") + dx).alias("left"), (F.col("top") + dy).alias("top")) for dx in (0, half) for dy in (0, half)]
        split = judged.filter("NOT below").drop("below").withColumn("q", F.explode(F.array(*quarters))).withColumns({"left": F.col("q.left"), "top": F.col("q.top")}).drop("q")
        touches = (F.col("x1") < F.col("left") + half) & (F.col("x2") > F.col("left")) & (F.col("y1") < F.col("top") + half) & (F.col("y2") > F.col("top"))
        cells, side = cut_lineage(split.filter(touches)), half
    return reduce(DataFrame.unionByName, found).distinct()


def duplicate_pairs(detections: DataFrame, spatial: float = SPATIAL_IOU, same_text: float = SAME_TEXT_IOU, **limits) -> DataFrame:
    """``(map_name, keeper, duplicate, overlap)``: each dropped box with the best box that drops it.

    Where no bin was crowded the keepers come out of the suppression. Else kept boxes are matched with
    dropped ones: they overlap little, so a bin has few of them, and a large group of copies costs one
    comparison per copy and keeper.
    """
    dropped, direct = _suppressed(detections, spatial, same_text, **limits)
    if direct:
        return dropped.select("map_name", "keeper", F.col("det_id").alias("duplicate"), F.round("overlap", 6).alias("overlap"))
    binned = in_bins(prepared(detections))
    keepers = binned.join(dropped, ["map_name", "det_id"], "left_anti").alias("a")
    fallen = binned.join(dropped, ["map_name", "det_id"], "left_semi").alias("b")
    found = keepers.join(fallen, _same_bin() & _meet() & _outranks() & is_duplicate(spatial, same_text))
    best = F.min(
        F.struct((-F.col("a.confidence")).alias("c"), F.col("a.y1"), F.col("a.x1"), F.col("a.det_id").alias("k"), F.round(iou(), 6).alias("o"))
    ).alias("best")
    return found.groupBy(F.col("b.map_name").alias("map_name"), F.col("b.det_id").alias("duplicate")).agg(best).select(
        "map_name", F.col("best.k").alias("keeper"), "duplicate", F.col("best.o").alias("overlap")
    )


def _without_copies(boxes: DataFrame) -> DataFrame:
    """Best of the boxes with the same place and text; the others cannot survive it.

    Whatever suppresses the best copy suppresses the rest as well, so removing them first
    changes nothing, and partial aggregation shrinks a large group of copies before it moves.
    """
    keys = ["map_name", "x1", "y1", "x2", "y2", "text_key"]
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    alone = F.when(solid, F.lit(None)).otherwise(F.col("det_id"))
    best = boxes.groupBy(*keys, alone.alias("alone")).agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), F.col("det_id").alias("d"))).alias("best")
    )
    return best.select(*keys, (-F.col("best.c")).alias("confidence"), F.col("best.d").alias("det_id"))


def _edges(binned: DataFrame, spatial: float, same_text: float, bin_size: int) -> DataFrame:
    """Duplicate pairs with what ``suppress`` needs of both boxes; cells are those of the bins they were found in."""
    pairs = overlapping_pairs(binned, bin_size, is_duplicate(spatial, same_text))
    traits = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("a", "hi"), ("b", "lo")) for c in ("confidence", "y1", "x1", "complete")]
    per_cell = max(1, CELL_SIZE // bin_size)
    cell = F.concat_ws("/", F.floor(F.col("a.bin_x") / per_cell), F.floor(F.col("a.bin_y") / per_cell))
    return pairs.select(F.col("a.map_name").alias("map_name"), cell.alias("cell"), F.col("a.det_id").alias("hi"), F.col("b.det_id").alias("lo"), iou().alias("overlap"), *traits)


def _leading(binned: DataFrame, crowded: int, bin_size: int) -> DataFrame:
    """The best ``crowded`` boxes of each bin; ``complete`` if a box leads in all its bins."""
    # row_number() <= k keeps at most k rows per bin in every map task before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*_BIN).orderBy(F.desc("confidence"), "y1", "x1", "det_id"))
    leading = cut_lineage(binned.withColumn("rank", rank).filter(F.col("rank") <= crowded).drop("rank"))
    def wide(low: str, high: str) -> Column:
        return _bin(F.col(high) - 1, bin_size) - _bin(F.col(low), bin_size) + 1

    touched = wide("x1", "x2") * wide("y1", "y2")
    whole = leading.groupBy("map_name", "det_id", touched.alias("touched")).agg(F.count("*").alias("seen"))
    flags = whole.select("map_name", "det_id", (F.col("seen") == F.col("touched")).alias("complete"))
    return cut_lineage(leading.join(flags, ["map_name", "det_id"]))


def _suppressed(
    detections: DataFrame, spatial: float = SPATIAL_IOU, same_text: float = SAME_TEXT_IOU,
    bin_size: int = BIN_SIZE, crowded: int = CROWDED,
) -> tuple[DataFrame, bool]:
    """``(map_name, det_id)`` of dropped boxes; without crowded bins also ``keeper`` and ``overlap``, and True."""
    keys = ["map_name", "det_id"]
    open_boxes = cut_lineage(prepared(detections))
    parts: list[DataFrame] = []
    merged = False
    while True:
        binned = in_bins(open_boxes, bin_size)
        if binned.groupBy(*_BIN).agg(F.count("*").alias("n")).filter(F.col("n") > crowded).isEmpty():
            last = suppress(_edges(binned.withColumn("complete", F.lit(True)), spatial, same_text, bin_size)).filter("dropped")
            if not parts:
                return last.drop("dropped"), True
            parts.append(last.select(*keys))
            break
        if not merged:
            unique = cut_lineage(_without_copies(open_boxes))
            parts.append(open_boxes.select(*keys).join(unique, keys, "left_anti"))
            open_boxes, merged = unique, True
            continue
        flagged = _leading(binned, crowded, bin_size)
        found = suppress(_edges(flagged, spatial, same_text, bin_size))
        dropped, waiting = found.filter("dropped").select(*keys), found.filter("NOT dropped").select(*keys)
        kept = cut_lineage(
            flagged.filter("complete").select(*keys).distinct().join(dropped, keys, "left_anti").join(waiting, keys, "left_anti")
        )
        rest = open_boxes.join(kept.unionByName(dropped), keys, "left_anti")
        keepers = flagged.drop("complete").join(kept, keys, "left_semi")
        shadowed = cut_lineage(overshadowed_by(in_bins(rest, bin_size), keepers, spatial, same_text))
        parts += [dropped, shadowed]
        open_boxes = cut_lineage(rest.join(shadowed, keys, "left_anti"))
    return reduce(DataFrame.unionByName, parts), False


def dropped_boxes(detections: DataFrame, **limits) -> DataFrame:
    """``(map_name, det_id)`` of the boxes that greedy suppression drops.

    Boxes are taken by falling confidence; a kept box drops its duplicates and a dropped box
    drops nobody. Only boxes of the same search bin are compared. While some bin has more than
    ``crowded`` boxes, copies are merged, and then such bins compare their best boxes first;
    the boxes these keep drop from the rest of the bin without pairing that rest among itself,
    and what remains goes round again.
    """
    return _suppressed(detections, **limits)[0].select("map_name", "det_id")


def overshadowed_by(binned: DataFrame, keepers: DataFrame, spatial: float, same_text: float) -> DataFrame:
    """Boxes that some keeper of the same bin duplicates; a bin has few keepers, many boxes."""
    condition = _same_bin() & _meet() & _outranks() & is_duplicate(spatial, same_text)
    return binned.alias("b").join(keepers.alias("a"), condition, "left_semi").select("map_name", "det_id").distinct()


def kept_boxes(detections: DataFrame, **limits) -> DataFrame:
    """``(map_name, det_id)`` of the boxes that greedy suppression keeps."""
    return detections.select("map_name", "det_id").join(dropped_boxes(detections, **limits), ["map_name", "det_id"], "left_anti")


def deduplicate(detections: DataFrame, **limits) -> DataFrame:
    """Detections that survive greedy duplicate suppression (see ``dropped_boxes``)."""
    return detections.join(dropped_boxes(detections, **limits), ["map_name", "det_id"], "left_anti")


def dedupe_report(detections: DataFrame, dropped: DataFrame) -> DataFrame:
    """Raw, kept and removed counts per map."""
    raw = detections.groupBy("map_name").agg(F.count("*").alias("raw"))
    gone = dropped.groupBy("map_name").agg(F.count("*").alias("removed"))
    removed = F.coalesce("removed", F.lit(0))
    return raw.join(gone, "map_name", "left").select("map_name", "raw", (F.col("raw") - removed).alias("kept"), removed.alias("removed"))


# ---- legend ------------------------------------------------------------------------------


def legend_top(segments: DataFrame, maps: DataFrame) -> DataFrame:
    """Upper edge of the legend: highest level line in the lowest 30 %, at least 75 % down."""
    level = F.degrees(F.atan2(F.abs(F.col("y2") - F.col("y1")), F.abs(F.col("x2") - F.col("x1")))) < 5
    sized = segments.join(maps.select("map_name", "height"), "map_name")
    found = sized.filter(level & (F.col("y1") >= F.floor(F.col("height") * 0.70))).groupBy("map_name").agg(F.min("y1").alias("line_y"))
    top = F.greatest(F.coalesce("line_y", F.floor(F.col("height") * 0.88)), F.when(F.col("line_y").isNotNull(), F.floor(F.col("height") * 0.75)))
    return maps.select("map_name", "height").join(found, "map_name", "left").select("map_name", top.cast("int").alias("legend_top"))


def map_body(detections: DataFrame, legends: DataFrame) -> DataFrame:
    """Detections that end above the legend of their map."""
    return detections.join(legends, "map_name").filter(F.col("y2") <= F.col("legend_top")).drop("legend_top")
