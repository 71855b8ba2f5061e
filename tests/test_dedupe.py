"""Greedy duplicate suppression against brute force, including crowded places."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetlore.operators import detections as op
from sheetlore.operators import suppression
from sheetlore.session import cut_lineage

SCHEMA = "map_name string, det_id bigint, text string, confidence double, x1 int, y1 int, x2 int, y2 int"


def greedy(rows):
    def key(text):
        return re.sub(r"[^0-9a-z]", "", text.lower())

    def iou(a, b):
        wide, high = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        if wide <= 0 or high <= 0:
            return 0.0
        shared = wide * high
        joint = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - shared
        return shared / joint

    kept = []
    for row in sorted(rows, key=lambda r: (-r[3], r[5], r[4], r[1])):
        same = [k for k in kept if k[0] == row[0]]
        if not any(iou(k, row) > 0.4 or (iou(k, row) > 0.2 and key(k[2]) == key(row[2])) for k in same):
            kept.append(row)
    return {(r[0], r[1]) for r in kept}


def boxes(n, maps, width, height, seed, words=("Ranchi", "ranchi!", "Koel", "12")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(width), rng.randrange(height)
        w, h = rng.randrange(8, 90), rng.randrange(6, 30)
        rows.append((f"M{rng.randrange(maps)}", i, rng.choice(words), round(rng.uniform(0.3, 1.0), 2), x, y, x + w, y + h))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_greedy(spark, seed):
    rows = boxes(600, 2, 700, 500, seed)
    got = op.kept_boxes(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in got.collect()} == greedy(rows)


@pytest.mark.parametrize("crowded", [12, 40])
def test_crowded_bins_match_greedy(spark, crowded):
    # Most boxes lie in two search bins, and a third are copies of one box.
    rows = boxes(250, 1, 200, 100, 7)
    rows += [("M0", 1000 + i, "Ranchi" if i % 2 else "Koel", round(0.4 + (i % 50) / 100, 2), 60, 40, 120, 60) for i in range(120)]
    got = op.kept_boxes(spark.createDataFrame(rows, SCHEMA), crowded=crowded)
    assert {tuple(r) for r in got.collect()} == greedy(rows)


def test_chain_keeps_third(spark):
    # A beats B, B would beat C, but B is gone: C stays.
    rows = [("M", 1, "a", 0.9, 0, 0, 100, 10), ("M", 2, "b", 0.8, 40, 0, 140, 10), ("M", 3, "c", 0.7, 80, 0, 180, 10)]
    got = op.kept_boxes(spark.createDataFrame(rows, SCHEMA))
    assert {r.det_id for r in got.collect()} == {1, 3}


def test_flat_boxes_stay(spark):
    rows = [("M", 1, "a", 0.9, 5, 5, 5, 9), ("M", 2, "a", 0.8, 5, 5, 5, 9), ("M", 3, "a", 0.8, 5, 5, 9, 9), ("M", 4, "a", 0.7, 5, 5, 9, 9)]
    for crowded in (1, 200):
        got = op.kept_boxes(spark.createDataFrame(rows, SCHEMA), crowded=crowded)
        assert {r.det_id for r in got.collect()} == {1, 2, 3}


def test_result_is_stable_and_free_of_duplicates(spark):
    rows = boxes(400, 2, 400, 300, 11)
    frame = spark.createDataFrame(rows, SCHEMA)
    dropped = op.dropped_boxes(frame)
    once = cut_lineage(op.deduplicate(frame))
    pairs = op.duplicate_pairs(frame).collect()
    assert {p.duplicate for p in pairs} == {r.det_id for r in dropped.collect()}
    assert len({p.duplicate for p in pairs}) == len(pairs) == len(rows) - once.count()
    assert {p.keeper for p in pairs} <= {r.det_id for r in once.collect()}
    assert op.deduplicate(once).count() == once.count()


def test_pair_search_has_no_cross_product(spark):
    frame = spark.createDataFrame(boxes(50, 2, 300, 300, 3), SCHEMA)
    plan = op.overlapping_pairs(op.in_bins(op.prepared(frame)), also=op.is_duplicate())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_long_chain_takes_few_jobs(spark):
    """10,000 boxes in a line, each a duplicate of the next, over many cells: every second one stays."""
    rows = [("M", k, f"t{k}", round(1 - k / 20_000, 6), 40 + (k % 2_500) * 12, 40 + (k // 2_500) * 12, 70 + (k % 2_500) * 12, 52 + (k // 2_500) * 12) for k in range(2_500)]
    rows += [("M", 2_500 + k, f"u{k}", round(0.8 - k / 20_000, 6), 40 + k * 4, 3000, 50 + k * 4, 3010) for k in range(7_500)]
    frame = cut_lineage(spark.createDataFrame(rows, SCHEMA))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    kept = {r.det_id for r in op.kept_boxes(frame).collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext._jsc.clearJobGroup()
    assert kept == {r[1] for r in greedy_line(rows)}
    spark.sparkContext.setJobGroup("pair", "pair")
    op.kept_boxes(cut_lineage(spark.createDataFrame(rows[:2], SCHEMA))).collect()
    short = len(tracker.getJobIdsForGroup("pair"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs <= short + 4  # more partitions may make the planner cut a stage; the length of the chain makes none


def greedy_line(rows):
    """As ``greedy``, for rows in order of priority whose duplicates are close in that order."""
    out = []
    for row in rows:
        if greedy([*out[-12:], row]) >= {(row[0], row[1])}:
            out.append(row)
    return out


def test_large_groups_go_by_rounds(spark, monkeypatch):
    monkeypatch.setattr("sheetlore.operators.suppression.suppress.__defaults__", (3,))
    rows = boxes(500, 2, 600, 400, 21)
    got = op.kept_boxes(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in got.collect()} == greedy(rows)


@pytest.mark.parametrize("crowded", [4, 60])
def test_better_neighbours_in_a_hot_place(spark, crowded):
    """A third of all boxes lie in one bin, many in one pixel; all leaves hold at most the bound, or are covered."""
    rows = boxes(400, 2, 700, 500, 13)
    rng = random.Random(3)
    rows += [("M0", 2000 + i, "x", round(rng.uniform(0.2, 1), 3), 300 + rng.randrange(9), 200 + rng.randrange(9), 312 + rng.randrange(40), 212 + rng.randrange(40)) for i in range(250)]
    rows += [("M0", 3000, "far", 0.5, 40_000, 10, 40_100, 30), ("M0", 3001, "far", 0.4, 40_050, 10, 40_150, 30), ("M0", 3002, "neg", 0.4, -50, -50, -10, -10), ("M0", 3003, "neg", 0.3, -40, -40, -20, -20)]
    got = {tuple(r) for r in op.better_neighbours(spark.createDataFrame(rows, SCHEMA), crowded=crowded).collect()}
    above = lambda a, b: (-a[3], a[5], a[4], a[1]) < (-b[3], b[5], b[4], b[1])
    meet = lambda a, b: a[4] < b[6] and b[4] < a[6] and a[5] < b[7] and b[5] < a[7]
    assert got == {(b[0], b[1]) for b in rows if any(a[0] == b[0] and above(a, b) and meet(a, b) for a in rows)}


def test_tiles_cover_the_picture(spark):
    maps = spark.createDataFrame([("a", 5000, 7000), ("b", 1005, 974), ("c", 30, 40)], "map_name string, width int, height int")
    tiles = op.plan_tiles(maps).collect()
    for name, width, height in (("a", 5000, 7000),):
        mine = [t for t in tiles if t.map_name == name]
        assert max(t.x2 for t in mine) == width and max(t.y2 for t in mine) == height
        assert {t.x for t in mine} == set(range(0, width, 974))
    assert {(t.x, t.y, t.x2, t.y2) for t in tiles if t.map_name == "b"} == {(0, 0, 1005, 974)}
    assert not [t for t in tiles if t.map_name == "c"]


def test_batches_number_in_reading_order(spark):
    frame = spark.createDataFrame(boxes(300, 2, 400, 300, 5), SCHEMA)
    rows = op.batches(frame, 16).collect()
    for name in ("M0", "M1"):
        mine = sorted((r for r in rows if r.map_name == name), key=lambda r: (r.y1, r.x1, r.det_id))
        assert [(r.batch, r.item) for r in mine] == [(i // 16, i % 16 + 1) for i in range(len(mine))]


def test_legend(spark):
    maps = spark.createDataFrame([("a", 1000, 1000), ("b", 1000, 1000), ("c", 1000, 1000)], "map_name string, width int, height int")
    lines = spark.createDataFrame(
        [("a", 0, 720, 900, 725), ("a", 0, 900, 900, 900), ("b", 0, 800, 900, 800), ("b", 0, 710, 10, 900), ("c", 0, 100, 900, 100)],
        "map_name string, x1 int, y1 int, x2 int, y2 int",
    )
    got = {r.map_name: r.legend_top for r in op.legend_top(lines, maps).collect()}
    assert got == {"a": 750, "b": 800, "c": 880}
    body = spark.createDataFrame([("a", 750), ("a", 751)], "map_name string, y2 int")
    assert op.map_body(body, op.legend_top(lines, maps)).select(F.max("y2")).first()[0] == 750


def test_small_groups_are_settled_together():
    """A batch of a thousand groups of two edges goes in one turn, cut anywhere; the third box of a chain comes free again."""
    chain = [(1, 2, 0.9, 0.8), (2, 3, 0.8, 0.7)]
    edges = pa.Table.from_pylist([
        {"map_name": f"M{m:04d}", "cell": "0/0", "whole": "w", "part": f"0/0:{hi}", "other": f"0/0:{lo}", "hi": hi, "lo": lo, "overlap": 0.5}
        | {f"{side}_{k}": v for side, c in (("hi", a), ("lo", b)) for k, v in (("confidence", c), ("y1", 0), ("x1", 0), ("complete", True))}
        for m in range(1000) for hi, lo, a, b in chain
    ])
    for size in (2000, 333, 1):
        batches = edges.to_batches(max_chunksize=size)
        settled = list(suppression._settled(iter(batches)))
        assert size == 1 or len(settled) <= len(batches) + 1
        assert [(r["map_name"], r["det_id"], r["keeper"]) for b in settled for r in b.to_pylist()] == [(f"M{m:04d}", 2, 1) for m in range(1000)]
        celled = [r["part"] for b in suppression._in_cells(iter(batches)) for r in b.to_pylist()]
        assert celled == ["0/0:1"] * 2000
        across = [(r["map_name"], r["part"], r["whole"]) for b in suppression._across_cells(iter(batches)) for r in b.to_pylist()]
        assert across == [(f"M{m:04d}", f"0/0:{k}", "0/0:1") for m in range(1000) for k in (1, 2, 3)]
