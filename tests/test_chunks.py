"""Hot maps: lines folded in chunks, rules by the thousand, texts of a map in parts."""

import random
import time

import pytest

from sheetlore.operators import country, years

TOKENS = "map_name string, text string, x1 int, y1 int, y2 int, token_no int"


def sequential(rows):
    """Lines of one map's tokens, folded one after another."""
    tokens = sorted(((r[3] + r[4]) / 2, r[2], r[5], r[1], float(max(r[4] - r[3], 1))) for r in rows)
    breaks, _ = years.fold_breaks([t[0] for t in tokens], [t[4] for t in tokens], None)
    lines = []
    for token, new in zip(tokens, breaks, strict=True):
        if new:
            lines.append([])
        lines[-1].append(token)
    return sorted((" ".join(t[3] for t in sorted(line, key=lambda t: (t[1], t[0], t[2]))), len(line), round(sum(t[0] for t in line) / len(line), 6)) for line in lines)


@pytest.mark.parametrize("step, height", [(1, 10), (0, 9), (3, 4)])
def test_a_map_without_gaps_is_folded_in_chunks(spark, monkeypatch, step, height):
    """Evenly spaced tokens (no gap to cut at), tokens of one height, and lines close to each other."""
    monkeypatch.setattr(years, "CHUNK", 37)
    rng = random.Random(step)
    rows = [("hot", f"w{k}", rng.randrange(4000), 100 + k * step // 2 + rng.randrange(2), 100 + k * step // 2 + height + rng.randrange(3), k) for k in range(900)]
    rows += [("other", f"v{k}", rng.randrange(4000), 50 * (k // 8), 50 * (k // 8) + 9, k) for k in range(60)]
    got = years.group_lines(spark.createDataFrame(rows, TOKENS).repartition(6)).collect()
    for name in ("hot", "other"):
        mine = [r for r in rows if r[0] == name]
        assert sorted((r.text, r.n, round(r.cy, 6)) for r in got if r.map_name == name) == sequential(mine)
        numbers = [(r.segment, r.line_no) for r in got if r.map_name == name]
        assert len(set(numbers)) == len(numbers)


def test_many_rules_cost_as_much_as_few(spark):
    """The time of 2,000 rules is that of 50, give or take the machine's moods; results equal plain tests."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(600)]
    every = [(f"{word()} {word()}" if k % 3 else word(), "x", 1, bool(k % 2)) for k in range(2000)]
    documents = spark.createDataFrame([(f"M{k % 40}", t) for k, t in enumerate(texts)], "map_name string, document string").repartition(4).cache()
    documents.count()

    def run(rules):
        best = 1e9
        for _ in range(3):
            begin = time.perf_counter()
            hits = {tuple(r) for r in country.rule_hits(documents, rules).collect()}
            best = min(best, time.perf_counter() - begin)
        return best, hits

    few, _ = run(tuple(every[:50]))
    many, hits = run(tuple(every))
    assert many < 4 * few + 1
    want = set()
    for k, text in enumerate(texts):
        padded = f" {text} "
        want |= {(f"M{k % 40}", no) for no, (p, _, _, whole) in enumerate(every) if (f" {p} " in padded if whole else p in text)}
    assert {h for h in hits if h[1] >= 0} == want


def test_rules_at_word_borders(spark):
    rules = (("ign", "a", 1, True), ("s\\.o\\.i\\.", "b", 1, False), ("new delhi", "c", 1, True), ("x[0-9]y", "d", 1, False), ("delhi", "e", 1, False))
    documents = spark.createDataFrame([("1", "SIGN ign_ ign2"), ("2", "(IGN)"), ("3", "the S.O.I. map"), ("4", "New Delhis"), ("5", "New Delhi, x7y"), ("6", None), ("7", "")], "map_name string, document string")
    got = {tuple(r) for r in country.rule_hits(documents, rules).filter("rule_no >= 0").collect()}
    assert got == {("2", 0), ("3", 1), ("4", 4), ("5", 2), ("5", 3), ("5", 4)}


def test_a_hot_map_has_many_parts(spark):
    rows = [("hot", k, f"t{k}") for k in range(500)] + [("cold", 0, "x")]
    got = country.map_documents(spark.createDataFrame(rows, "map_name string, seq long, text string"), 64).collect()
    parts = sorted((r.part, r.document) for r in got if r.map_name == "hot")
    assert len(parts) == 8 and max(len(p.split()) for _, p in parts) == 64
    assert " ".join(p for _, p in parts) == " ".join(f"t{k}" for k in range(500))


def test_a_sheet_without_image_verdict_keeps_the_text_s(spark):
    texts = spark.createDataFrame([("A", "uk"), ("B", "india"), ("C", "usa")], "map_name string, country string")
    images = spark.createDataFrame([("A", "france", 0.9), ("B", "uk", 0.5)], "map_name string, image_country string, image_confidence double")
    got = {tuple(r) for r in country.fuse_verdicts(texts, images).collect()}
    assert got == {("A", "france", "image"), ("B", "india", "conflict"), ("C", "usa", "text only")}
