"""The Merkle manifest against a plain recursive tree, and its addresses against the log as written."""

import hashlib
import zlib

import pytest

from sheetlore.llm import merkle_log

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, idx long, path string"


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        out.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else ""))
        at >>= 1
    return out


def brute_force(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in rs]) for x, rs in own.items()}
    top = levels([trees[x][-1][0] for x in langs])
    for number, x in enumerate(langs):
        for at, r in enumerate(own[x]):
            path = siblings(trees[x], at) + siblings(top, number)
            struck = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf((*r[:3], r[3] + 1, r[4])) if struck else leaf(r)
            for right, other in path:
                node = sha(other + node if right else node + other)
            root = top[-1][0]
            yield r[0], leaf(r), trees[x][-1][0], root, sha("".join(s for _, s in path)), node, node == root


ROWS = (
    [(k, f"s{k % 3}", "hot", k, f"text {k}") for k in range(2100)]
    + [(k, None, None, None, None) for k in (5, 6, 7)]
    + [(k, "é", "ö", 2, "") for k in range(8)]
    + [(None, "x", "z", 1, "t"), (9, "x", "z", 1, "t"), (9, "x", "z", 1, "t"), (9, "x", "z", 2, "t"), (3, "", "", 0, "alone")]
)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "a", 1, "p") for r in rows], SCHEMA).repartition(5)
    return [tuple(r) for r in merkle_log.merkle_manifest(docs).collect()]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:1025], []], ids=["mixed", "lone", "two blocks", "empty"])
def test_manifest_equals_plain_tree(spark, rows):
    key = lambda r: (r[0] is not None, r)
    assert sorted(run(spark, rows), key=key) == sorted(brute_force(rows), key=key)


def test_addresses_are_places_in_the_log():
    for leaves in (1, 2, 3, 7, 8, 13, 64, 100):
        top = merkle_log.levels_of(leaves)
        log = list(merkle_log.append([str(k) for k in range(leaves)], top))
        assert [merkle_log.postorder(level, index, leaves) for level, index, _ in log] == list(range(len(log)))


def test_stored_log_is_in_postorder(spark):
    rows = spark.createDataFrame([("g", k, 2500, sha(str(k))) for k in range(2500)], "grp string, idx long, n long, digest string")
    tree = merkle_log.Tree(rows)
    log = tree.log().orderBy("position").collect()
    assert [r.position for r in log] == list(range(len(log)))
    assert [(r.level, r.idx, r.digest) for r in log] == list(merkle_log.append([sha(str(k)) for k in range(2500)], 12))
    assert tree.roots.first().root == log[-1].digest
