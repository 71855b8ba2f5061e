"""Licence notices as they stand in files, prose that only speaks of licences, and features and shares by brute force."""

import pytest

from sheetlore.llm import license_scan

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software."""
ISC = """ISC License

Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""
PROSE = "It rained all day and the road to the mill was closed.\nThe miller went home.\n"


def comment(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


CASES = [
    (APACHE, [(0, "Apache-2.0"), (6, "Apache-2.0")]), (comment(APACHE, "#"), [(0, "Apache-2.0"), (6, "Apache-2.0")]),
    (comment(APACHE, " *"), [(0, "Apache-2.0"), (6, "Apache-2.0")]), (ZLIB, [(0, "Zlib")]), (comment(ZLIB, "//"), [(0, "Zlib")]),
    (ISC, [(0, "ISC"), (2, "ISC")]), (BSD, [(0, "BSD")]), ("MIT License", [(0, "MIT")]), ("The MIT License (MIT)", [(0, "MIT")]),
    ("\n".join(license_scan.TEMPLATES["MIT"][5].split(" ")), [(0, "MIT")]),
    (PROSE + "Released under the MIT License.\n" + PROSE, [(2, "MIT")]), (PROSE * 200 + ZLIB + "\n" + PROSE * 200, [(400, "Zlib")]),
    ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", [(0, "Apache-2.0"), (1, "MIT")]),
    ("License: Frobnicate-9", [(0, "unknown")]), ("Licensed under the Frobnicate Public License, version 9.", [(0, "unknown")]),
    ("He lost his driving licence.", []), ("The town gave him a licence to fish in the river.", []), (PROSE * 50, []), ("", []), (None, []),
    ("She asked for permission to use the above room, without any fee.", []),
]


def rows(spark):
    docs = spark.createDataFrame([(k, t, "f", 1, 2) for k, (t, _) in enumerate(CASES)], "doc_id long, text string, family string, paragraph int, rid int")
    got = {}
    for r in license_scan.license_paragraphs(docs.repartition(4)).collect():
        got.setdefault(r.doc_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.paragraph) for k, v in got.items()}


@pytest.fixture(scope="module")
def found(spark):
    return rows(spark)


def test_notices_get_one_row_each(found):
    wrong = {k: [(r.paragraph, r.family, round(r.probability, 2)) for r in found.get(k, [])] for k, (_, want) in enumerate(CASES) if [(r.paragraph, r.family) for r in found.get(k, [])] != want}
    assert not wrong


def test_shares_equal_brute_force(spark):
    """The share of the best template of the family, from the words of paragraphs that are one notice each."""
    texts = [t for t in (ZLIB, BSD, comment(ZLIB, "//"), APACHE.split("\n\n")[0], APACHE.split("\n\n")[2], ISC.split("\n\n")[1], "License: MIT", *license_scan.TEMPLATES["MIT"][:6])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_paragraphs(docs).collect()}
    for k, text in enumerate(texts):
        lines = [license_scan.words_of(line)[1:] for line in text.split("\n")]
        grams = license_scan.features_of([license_scan.BEGIN, *(w for line in lines for w in line)])
        own = [license_scan.features_of(license_scan.words_of(t)[1:]) for t in license_scan.TEMPLATES[got[k].family]]
        share = max(len(g & grams) / len(g) for g in own)
        assert got[k].template_share == pytest.approx(share) and got[k].confirmed == (share >= license_scan.CONFIRMING_SHARE)


def test_held_out_notices_and_prose():
    """Precision and recall of the classifier on notices with other words around them, and on words of prose in any order."""
    import random

    import numpy as np

    classes, weights, bias, bound = license_scan.trained()
    at = {g: k for k, g in enumerate(license_scan.vocabulary())}
    rng = random.Random(5)

    def family(words):
        hit = [at[g] for g in license_scan.features_of(words) if g in at]
        p = license_scan._softmax((weights[hit].sum(axis=0) + bias)[None])[0]
        return classes[p.argmax()] if p.argmax() == 0 or p.max() >= bound else license_scan.UNKNOWN

    right = total = 0
    for name, texts in license_scan.TEMPLATES.items():
        for text in texts:
            words = license_scan.words_of(text)
            if len(words) > 8:
                for _ in range(5):
                    noisy = [f"q{rng.randrange(99)}" for _ in range(3)] + [w for w in words if rng.random() > 0.08] + [f"q{rng.randrange(99)}" for _ in range(3)]
                    right += family(noisy) == name
                    total += 1
    assert right / total >= 0.85
    prose = [w for t in license_scan.OTHERS for w in license_scan.words_of(t)[1:]]
    flagged = np.mean([family([license_scan.BEGIN, *rng.choices(prose, k=60)]) != license_scan.PROSE for _ in range(400)])
    assert flagged <= 0.03
