"""Merkle manifest of a data set as a log of tree nodes in postorder.

Leaves are numbered per group. Builders own aligned blocks of leaves and append each node when it is
complete, so a block's nodes are one run of the log and a parent follows its children. What the blocks
end in are the leaves of the next tier, until a group has one node. Where a node stands in the log
follows from the sizes of the subtrees complete before it, so siblings are addressed by arithmetic
alone, in the whole log (``position``) as in a block's run of it (``place``).

Proofs go down the tiers: a block's proof is known when its leaves are taken up, and they add the
siblings inside the block. No task holds more than a block, no path is longer than the tree is high.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlore.llm.common import python_ready, stored

#: Levels of a block's tree: a builder owns 2 ** TIER leaves.
TIER = 10
#: The columns of a leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_LOG = "grp string, block long, place long, position long, level int, idx long, digest string, n long, n_up long, top boolean"
_NODES = ["grp", "idx", "n", "digest"]


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def postorder(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder log of a tree over ``leaves`` leaves.

    A node that is full comes after all nodes complete by the leaf before its last one, and after its
    own lower levels; nodes cut short by the end come after all full ones, from the lowest level on.
    """
    end = (index + 1) << level
    if end <= leaves:
        return 2 * (end - 1) - (end - 1).bit_count() + level
    return 2 * leaves - leaves.bit_count() + sum(leaves % (1 << lower) != 0 for lower in range(level))


def levels_of(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    return (leaves - 1).bit_length()


def append(digests: list[str], levels: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of all nodes over some leaves, in the order in which they are complete."""
    open_: list[list[str]] = [[] for _ in range(levels + 1)]  # per level: children that wait for their parent
    done = [0] * (levels + 1)

    def add(level: int, node: str) -> Iterator[tuple[int, int, str]]:
        yield level, done[level], node
        done[level] += 1
        if level < levels:
            open_[level].append(node)
            if len(open_[level]) == 2:
                parent = digest("".join(open_[level]))
                open_[level].clear()
                yield from add(level + 1, parent)

    for leaf in digests:
        yield from add(0, leaf)
    for level in range(levels):  # the last run of a level may have one node only
        if open_[level]:
            parent = digest("".join(open_[level]))
            open_[level].clear()
            yield from add(level + 1, parent)


def siblings(log: list[str], leaf: int, leaves: int, levels: int) -> list[str]:
    """The path of a leaf in a block's run of the log: L or R and the sibling's digest, or - where there is none."""
    path = []
    for level in range(levels):
        other = (leaf >> level) ^ 1
        if other << level >= leaves:
            path.append("-")
        else:
            path.append(("R" if other & 1 else "L") + log[postorder(level, other, leaves)])
    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    node = leaf
    for step in path:
        node = digest(node if step == "-" else step[1:] + node if step[0] == "L" else node + step[1:])
    return node


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_LOG_TYPES = pa.schema([
    ("grp", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("position", pa.int64()), ("level", pa.int32()),
    ("idx", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("n_up", pa.int64()), ("top", pa.bool_()),
])


def _builder(tier: int) -> Callable:
    """Builds aligned blocks of a tier's nodes; positions are those in the whole group's log."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple]:
            # grp, block, idx, n (nodes of the group on this tier), leaves (of the group), digest
            for (grp, block), rows in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
                own = list(rows)
                n, leaves = own[0][3], own[0][4]
                levels = min(TIER, levels_of(n))
                for place, (level, index, node) in enumerate(append([r[5] for r in own], levels)):
                    high, at = tier * TIER + level, (block << (TIER - level)) + index
                    yield grp, block, place, postorder(high, at, leaves), high, at, node, n, -(-n >> levels) if levels else n, level == levels

        yield from _batched(nodes(), _LOG_TYPES)

    return build


def numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with idx = 0, 1, ... in ``order`` within each grp, and n, the group's number of rows.

    Rows are dealt out and sorted by ranges; each range's rows of a group are shifted by the counts of
    the ranges before. ``order`` must tell all rows apart that may be too many for one task.
    """
    placed = stored(
        rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id()),
        "placed",
    )
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("own"), F.min("row").alias("first"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("shift", F.coalesce(F.sum("own").over(before), F.lit(0))).withColumn("n", F.sum("own").over(Window.partitionBy("grp")))
    joined = placed.join(shifts.drop("own"), ["grp", "part"])
    return joined.withColumn("idx", F.col("row") - F.col("first") + F.col("shift")).drop("part", "row", "first", "shift")


class Tree:
    """One tree per group: the log of each tier and the group's root."""

    def __init__(self, nodes: DataFrame):
        """``nodes``: grp, idx, n, digest of all leaves."""
        python_ready(nodes.sparkSession)
        self.logs: list[DataFrame] = []
        current = nodes.select(*_NODES, F.col("n").alias("leaves"))
        roots = None
        while True:
            block = F.shiftright("idx", TIER)
            dealt = current.select("grp", block.alias("block"), "idx", "n", "leaves", "digest")
            dealt = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")
            log = stored(dealt.mapInArrow(_builder(len(self.logs)), _LOG), f"log-{len(self.logs)}")
            sizes = current.filter("idx = 0").select("grp", "leaves")
            self.logs.append(log)
            tops = log.filter("top").select("grp", F.col("block").alias("idx"), F.col("n_up").alias("n"), "digest")
            done = tops.filter("n = 1").select("grp", F.col("digest").alias("root"))
            roots = done if roots is None else roots.unionByName(done)
            current = tops.filter("n > 1").join(sizes, "grp")
            if current.isEmpty():
                break
        self.roots = roots

    def log(self) -> DataFrame:
        """The manifest: grp, position, level, idx, digest of every node once, in postorder by position."""
        whole = None
        for tier, log in enumerate(self.logs):
            part = log if tier == 0 else log.filter(F.col("level") > tier * TIER)
            part = part.select("grp", "position", "level", "idx", "digest")
            whole = part if whole is None else whole.unionByName(part)
        return whole

    def extract(self, above: DataFrame, leaves: DataFrame, payload: list[str], finish: Callable, kind: str) -> DataFrame:
        """``finish(path, head, payload row)`` for every leaf, path and head being those of its group.

        ``above`` has grp, path (of the group's root) and head (one string that all its leaves get);
        ``leaves`` has grp, idx and the payload columns, which are strings.
        """
        upper = above.select("grp", F.lit(0).cast("long").alias("block"), "path", "head")
        for tier in range(len(self.logs) - 1, 0, -1):
            log = self.logs[tier]
            inner = log.filter(F.col("level") == tier * TIER).select("grp", "idx")
            paths = _proofs(log, upper, inner, [], lambda path, head, row: (",".join(path), head), "path string, head string")
            reached = upper.join(log.select("grp").distinct(), "grp", "left_anti")
            upper = stored(paths.select("grp", F.col("idx").alias("block"), "path", "head").unionByName(reached), "paths")
        return _proofs(self.logs[0], upper, leaves, payload, finish, kind)


def _proofs(log: DataFrame, upper: DataFrame, leaves: DataFrame, payload: list[str], finish: Callable, kind: str) -> DataFrame:
    """Meets each block's path, its run of the log and its leaves in one task, in this order."""
    empty = [F.lit(None).cast("string").alias(f"v{k}") for k in range(len(payload))]
    heads = upper.select("grp", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.col("path").alias("a"), F.col("head").alias("b"), *empty)
    nodes = log.select("grp", "block", F.lit(1).alias("kind"), F.col("place").alias("at"), "n", F.col("digest").alias("a"), F.lit("").alias("b"), *empty)
    own = leaves.select(
        "grp", F.shiftright("idx", TIER).alias("block"), F.lit(2).alias("kind"), F.col("idx").alias("at"), F.lit(0).cast("long").alias("n"),
        F.lit("").alias("a"), F.lit("").alias("b"), *[F.col(c).alias(f"v{k}") for k, c in enumerate(payload)],
    )
    names = [c.split()[0] for c in kind.split(", ")]
    types = pa.schema([("grp", pa.string()), ("idx", pa.int64()), *[(c, pa.bool_() if t.endswith("boolean") else pa.string()) for c, t in zip(names, kind.split(", "), strict=True)]])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (grp, block), rows in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
                path, head, run, n = [], "", [], 0
                for row in rows:
                    if row[2] == 0:
                        path, head = row[5].split(",") if row[5] else [], row[6]
                    elif row[2] == 1:
                        run.append(row[5])
                        n = row[4]
                    else:
                        here = min(n - (block << TIER), 1 << TIER)
                        mine = siblings(run, row[3] - (block << TIER), here, min(TIER, levels_of(n)))
                        yield (grp, row[3], *finish(mine + path, head, row[7:]))

        yield from _batched(found(), types)

    dealt = heads.unionByName(nodes).unionByName(own).repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "at")
    return dealt.mapInArrow(prove, f"grp string, idx long, {kind}")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(n_chars: Column) -> Column:
    values = [n_chars if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
    return F.sha2(F.concat(*map(_field, values)).cast("binary"), 256)


def manifest(docs: DataFrame) -> tuple[DataFrame, Tree, Tree, DataFrame]:
    """Numbered leaves (grp, idx, n, doc_id, leaf, tampered), the trees per lang, the tree over their roots, and its leaves."""
    struck = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    leaves = docs.select(
        F.concat(F.when(F.col("lang").isNull(), "0").otherwise("1"), F.coalesce("lang", F.lit(""))).alias("grp"),
        "doc_id", _leaf(F.col("n_chars")).alias("leaf"), F.when(struck, _leaf(more)).alias("tampered"), F.monotonically_increasing_id().alias("rid"),
    )
    rows = stored(numbered(stored(leaves, "leaves"), ["doc_id", "leaf", "rid"]).drop("rid"), "numbered")
    trees = Tree(rows.select("grp", "idx", "n", F.col("leaf").alias("digest")))
    groups = trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("root").alias("digest"))
    members = stored(numbered(groups, ["member"]), "members")
    return rows, trees, Tree(members.select(*_NODES)), members


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Every row's leaf, proof and the check of a tampered copy against the root.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A leaf is the digest of
    doc_id, source, lang, n_chars and text; per lang leaves ascend by doc_id and are joined in twos
    until one is left, and so are the langs' roots, null first. Where crc32 of the id is divisible by
    7, n_chars counts one more in the copy whose root is folded. Nulls and empty texts differ in a leaf.
    Null ids come first in their lang and are never tampered with; rows that repeat an id stand in the
    order of their leaves, each with a proof of its own. Other columns are not read; an empty table
    gives an empty one.
    """
    rows, trees, top, members = manifest(docs)
    first = top.roots.first()
    root = first["root"] if first else ""
    named = members.select("grp", "idx", "member", F.col("digest").alias("p0"))
    above = docs.sparkSession.createDataFrame([("", "", "")], "grp string, path string, head string")
    paths = top.extract(
        above, named, ["member", "p0"], lambda path, head, row: (row[0], ",".join(path), row[1]), "member string, path string, head string"
    )
    per_lang = stored(paths.select(F.col("member").alias("grp"), "path", "head"), "lang-paths")

    def finish(path: list[str], subroot: str, row: tuple) -> tuple:
        doc_id, leaf, tampered = row
        folded = fold(leaf if tampered is None else tampered, path)
        return doc_id, leaf, subroot, root, digest("".join(s[1:] for s in path if s != "-")), folded, folded == root

    kind = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = trees.extract(per_lang, rows.withColumn("doc_id", F.col("doc_id").cast("string")), ["doc_id", "leaf", "tampered"], finish, kind)
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), *[c.split()[0] for c in kind.split(", ")[1:]])


#: Unsigned crc32 of the ASCII text s, given the table as t, in DuckDB's SQL.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(%s, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
CRC_TABLE = """SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS k))"""


def _sql_leaf(n_chars: str) -> str:
    values = (f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)" for c in LEAF_COLUMNS)
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
made AS (
  SELECT CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, doc_id, {_sql_leaf('n_chars')} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {CRC32 % 'CAST(doc_id AS VARCHAR)'} % 7 = 0 THEN {_sql_leaf('(n_chars + 1)')} END AS tampered
  FROM documents, crc),
leaves AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM made WINDOW w AS (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf)),
up AS (
  SELECT grp, 0 AS l, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT grp, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), max((n + 1) // 2) FROM up WHERE n > 1 GROUP BY grp, l, i // 2),
subroots AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS l, i, h, n FROM subroots
  UNION ALL
  SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), max((n + 1) // 2) FROM over WHERE n > 1 GROUP BY l, i // 2),
walk AS (
  SELECT grp, i AS leaf_no, 0 AS l, i, n, coalesce(tampered, leaf) AS own, '' AS proof FROM leaves
  UNION ALL
  SELECT w.grp, leaf_no, w.l + 1, w.i // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.i % 2 = 1 THEN u.h || own ELSE own || coalesce(u.h, '') END), proof || coalesce(u.h, '')
  FROM walk w LEFT JOIN up u ON u.grp = w.grp AND u.l = w.l AND u.i = xor(w.i, 1) WHERE w.n > 1),
walk_over AS (
  SELECT grp, leaf_no, 0 AS l, s.i, s.n, own, proof FROM (SELECT * FROM walk WHERE n = 1) JOIN subroots s USING (grp)
  UNION ALL
  SELECT w.grp, leaf_no, w.l + 1, w.i // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.i % 2 = 1 THEN u.h || own ELSE own || coalesce(u.h, '') END), proof || coalesce(u.h, '')
  FROM walk_over w LEFT JOIN over u ON u.l = w.l AND u.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = r.h AS verified
FROM leaves JOIN (SELECT grp, leaf_no, own, proof FROM walk_over WHERE n = 1) w ON w.grp = leaves.grp AND leaf_no = leaves.i
JOIN subroots s ON s.grp = leaves.grp, (SELECT h FROM over WHERE n = 1) r
"""
