"""The vectorised word hashing sees the words that a split sees, wherever its stretches end."""

import random

import numpy as np

from sheetlore.llm import common


def test_words_are_those_of_a_split(monkeypatch):
    rng = random.Random(3)
    texts = ["", None, "  ", *("".join(rng.choice("abé \t\nXY.") for _ in range(rng.randint(0, 300))) for _ in range(40)), "q" * 9000]
    whole = common.word_hashes(texts, (2, 5))
    known = {}
    for text, begin, end in zip(texts, whole[1][:-1], whole[1][1:], strict=True):
        words = [w for w in common.np.char.split((text or "").translate({k: k + 32 for k in range(65, 91)})).item() if w]
        assert len(words) == end - begin
        for word, value in zip(words, whole[0][begin:end].tolist(), strict=True):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    for size in (1, 7, 64, 4096):
        monkeypatch.setattr(common, "STRETCH_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, common.word_hashes(texts, (2, 5)), strict=True))
