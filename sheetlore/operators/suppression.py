"""Greedy suppression over duplicate edges, one connected group at a time.

An edge joins two duplicate boxes of a map, the one of higher priority first. Edges are dealt out by
coarse cells of the picture; in a cell a task joins the boxes that edges connect, and boxes that lie in
several cells join the cells' groups, of which a map has as many as reach across a cell's border. A
group's boxes are then taken in order of priority inside one task. So a chain of any length takes as
many jobs as a single edge. Groups beyond a bound are settled by rounds over all of them instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheetlore.session import cut_lineage, ship_package

#: Edges of a group that one task takes in turn.
MOST_EDGES = 2_000_000
KEPT, DROPPED, OPEN = 1, 2, 0


class Groups:
    """Disjoint groups of numbers; the least one names a group."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _coded(run: np.ndarray, *columns: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Numbers for the values of some columns, those of each run apart and in order of the values; run and value of each number."""
    values, codes = np.unique(np.concatenate([c.to_numpy(zero_copy_only=False) for c in columns]), return_inverse=True)
    known, codes = np.unique(np.tile(run, len(columns)) * len(values) + codes, return_inverse=True)
    return np.split(codes, len(columns)), known // len(values), values[known % len(values)]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Consecutive rows with equal keys: tables of whole runs, as many as a batch has, and the run of each row."""

    def changes(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            codes = np.asarray(table.column(key).combine_chunks().dictionary_encode().indices.fill_null(-1))
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def whole(tables: list[pa.Table]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.concat_tables(tables).combine_chunks()
        if table.num_rows:
            yield table, np.cumsum(changes(table))

    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = changes(table)
        new[0] = bool(rest) and any(rest[-1].column(k)[-1].as_py() != table.column(k)[0].as_py() for k in keys)
        at = np.flatnonzero(new)
        if not len(at):
            rest.append(table)
            continue
        yield from whole([*rest, table.slice(0, int(at[-1]))])
        rest = [table.slice(int(at[-1]))]
    if rest:
        yield from whole(rest)


def _joined(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """The least number of the group that each number is in, when the pairs are joined."""
    groups = Groups(size)
    for a, b in zip(one.tolist(), two.tolist(), strict=True):
        groups.join(a, b)
    return np.array([groups.find(k) for k in range(size)], np.int64)


def _with_column(table: pa.Table, name: str, values: pa.Array) -> Iterator[pa.RecordBatch]:
    yield from table.append_column(name, values).combine_chunks().to_batches()


def _in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge with the group that the edges of its cell put it into: the cell and the least box of the group."""
    for edges, run in _runs(batches, ["map_name", "cell"]):
        (hi, lo), _, values = _coded(run, edges.column("hi"), edges.column("lo"))
        least = _joined(hi, lo, len(values))[hi]
        names = [f"{cell}:{value}" for cell, value in zip(edges.column("cell").to_pylist(), values[least].tolist(), strict=True)]
        yield from _with_column(edges, "part", pa.array(names, pa.string()))


def _across_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per map: the name that each of a cell's groups has after those with a box in common are joined."""
    for pairs, run in _runs(batches, ["map_name"]):
        (one, two), owner, values = _coded(run, pairs.column("part"), pairs.column("other"))
        names = values[_joined(one, two, len(values))]
        maps = pairs.column("map_name").combine_chunks().take(pa.array(np.searchsorted(run, owner)))
        yield pa.RecordBatch.from_arrays([maps, pa.array(values.tolist(), pa.string()), pa.array(names.tolist(), pa.string())], ["map_name", "part", "whole"])


def settle(hi: np.ndarray, lo: np.ndarray, rank: np.ndarray, complete: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, edge that drops it or -1) of each box of some groups, taken by rank.

    A box is dropped by a kept one; it stays open while one above it is open, or if it is not complete.
    The edge is that of the best box that drops it.
    """
    order = np.lexsort((rank[hi], rank[lo]))
    state, by = np.where(complete, KEPT, OPEN), np.full(len(rank), -1)
    state_, by_ = state.tolist(), by.tolist()
    for edge, a, b in zip(order.tolist(), hi[order].tolist(), lo[order].tolist(), strict=True):
        if state_[b] == DROPPED:
            continue
        if state_[a] == KEPT:
            state_[b], by_[b] = DROPPED, edge
        elif state_[a] == OPEN:
            state_[b] = OPEN
    return np.array(state_), np.array(by_)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for edges, run in _runs(batches, ["map_name", "whole"]):
        (hi, lo), _, values = _coded(run, edges.column("hi"), edges.column("lo"))
        size = len(values)
        traits = {}
        for name in ("confidence", "y1", "x1", "complete"):
            own = np.zeros(size, np.float64)
            own[hi], own[lo] = (edges.column(f"{side}_{name}").to_numpy(zero_copy_only=False).astype(np.float64) for side in ("hi", "lo"))
            traits[name] = own
        rank = np.empty(size, np.int64)
        rank[np.lexsort((np.arange(size), traits["x1"], traits["y1"], -traits["confidence"]))] = np.arange(size)
        state, by = settle(hi, lo, rank, traits["complete"] > 0)
        below, first = np.unique(lo, return_index=True)  # the others have nothing above them
        open_or_dropped = state[below] != KEPT
        below, first = below[open_or_dropped], first[open_or_dropped]
        dropped = state[below] == DROPPED
        at = pa.array(np.where(dropped, by[below], 0))
        yield pa.RecordBatch.from_arrays(
            [
                edges.column("map_name").combine_chunks().take(pa.array(first)), edges.column("lo").combine_chunks().take(pa.array(first)), pa.array(dropped),
                pa.compute.if_else(pa.array(dropped), edges.column("hi").combine_chunks().take(at), pa.scalar(None, edges.column("hi").type)),
                pa.compute.if_else(pa.array(dropped), edges.column("overlap").combine_chunks().take(at), pa.scalar(None, pa.float64())),
            ],
            ["map_name", "det_id", "dropped", "keeper", "overlap"],
        )


def _rounds(edges: DataFrame) -> DataFrame:
    """As ``suppress``, by rounds over all edges: a box that no open box outranks is kept and drops its neighbours."""
    edges = cut_lineage(edges)
    fallen, left = None, edges.count()
    while left:
        outranked = edges.select("map_name", F.col("lo").alias("hi")).distinct()
        ruling = edges.filter("hi_complete").join(outranked, ["map_name", "hi"], "left_anti")
        best = F.min(F.struct((-F.col("hi_confidence")).alias("c"), "hi_y1", "hi_x1", "hi", "overlap")).alias("best")
        falls = cut_lineage(ruling.groupBy("map_name", "lo").agg(best))
        gone = falls.select("map_name", "lo")
        rest = cut_lineage(
            edges.join(gone, ["map_name", "lo"], "left_anti").join(gone.withColumnRenamed("lo", "hi"), ["map_name", "hi"], "left_anti")
        )
        now = rest.count()
        if now == left:  # a box that falls takes at least one edge with it
            break
        some = falls.select("map_name", F.col("lo").alias("det_id"), F.lit(True).alias("dropped"), F.col("best.hi").alias("keeper"), F.col("best.overlap").alias("overlap"))
        fallen, edges, left = some if fallen is None else fallen.unionByName(some), rest, now
    waiting = edges.select("map_name", F.col("lo").alias("det_id")).distinct().select(
        "*", F.lit(False).alias("dropped"), F.lit(None).cast(edges.schema["hi"].dataType).alias("keeper"), F.lit(None).cast("double").alias("overlap")
    )
    return waiting if fallen is None else fallen.unionByName(waiting)


def suppress(edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(map_name, det_id, dropped, keeper, overlap) of all boxes that are dropped or stay open.

    ``edges`` has map_name, cell, hi, lo, overlap and, for both boxes, confidence, y1, x1 and complete
    (whether all edges from above are there), with the prefixes hi_ and lo_. The keeper is the best
    kept box with an edge to the dropped one.
    """
    ship_package(edges.sparkSession)
    kind = edges.schema
    dealt = edges.repartition("map_name", "cell").sortWithinPartitions("map_name", "cell")
    grouped = cut_lineage(dealt.mapInArrow(_in_cells, StructType([*kind.fields]).add("part", "string")))
    ends = grouped.select("map_name", F.col("hi").alias("box"), "part").unionByName(grouped.select("map_name", F.col("lo").alias("box"), "part"))
    shared = ends.groupBy("map_name", "box").agg(F.sort_array(F.collect_set("part")).alias("parts")).filter(F.size("parts") > 1)
    pairs = shared.select("map_name", F.col("parts")[0].alias("part"), F.explode(F.slice("parts", 2, 1 << 20)).alias("other")).distinct()
    names = pairs.repartition("map_name").sortWithinPartitions("map_name").mapInArrow(_across_cells, StructType([kind["map_name"]]).add("part", "string").add("whole", "string"))
    whole: Column = F.coalesce("whole", "part")
    placed = grouped.join(names, ["map_name", "part"], "left").withColumn("whole", whole).select(*kind.names, "whole")
    sizes = cut_lineage(placed.groupBy("map_name", "whole").agg(F.count("*").alias("edges")).filter(F.col("edges") > most_edges))
    out = StructType([kind["map_name"]]).add("det_id", kind["lo"].dataType).add("dropped", "boolean").add("keeper", kind["hi"].dataType).add("overlap", "double")
    if sizes.isEmpty():
        return cut_lineage(placed.repartition("map_name", "whole").sortWithinPartitions("map_name", "whole").mapInArrow(_settled, out))
    large = cut_lineage(placed.join(sizes, ["map_name", "whole"], "left_semi"))
    small = placed.join(sizes, ["map_name", "whole"], "left_anti")
    settled = small.repartition("map_name", "whole").sortWithinPartitions("map_name", "whole").mapInArrow(_settled, out)
    return cut_lineage(settled.unionByName(_rounds(large)))
