"""License scans against an alignment of every stretch of a text."""

import math

import numpy as np
import pytest

from corpuscope.llm import licenses

NAMES = dict(licenses.TEMPLATES)


def scan(spark, rows, templates=None, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS coverage", "'x' AS license_id")
    return licenses.scan_licenses(frame, templates or licenses.TEMPLATES, **options).collect()


def test_words_far_apart(spark):
    got = scan(spark, [(1, "released under x the y z mit q license"), (2, "released x under y the z mit q license"), (3, "license mit the under released")])
    assert {(r.doc_id, r.license_id, r.coverage) for r in got} == {(1, "MIT", 1.0), (2, "MIT", 1.0)}


def test_odd_rows(spark):
    mit, gpl = NAMES["MIT"], NAMES["GPL-3.0"]
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " .,"), (4, mit), (4, mit), (None, gpl), (5, f"{long} {mit} {long} {gpl.upper()}"), (6, f"{mit} {mit}")]
    got = sorted(((r.doc_id or 0, r.license_id) for r in scan(spark, rows)))
    assert got == [(0, "GPL-3.0"), (4, "MIT"), (4, "MIT"), (5, "GPL-3.0"), (5, "MIT"), (6, "MIT")]
    assert scan(spark, [(1, "see the unlicense here"), (2, "none")], [("U", "Unlicense"), ("empty", " ")])[0].license_id == "U"


@pytest.mark.parametrize("name", sorted(NAMES))
def test_every_notice_is_found(spark, name):
    """Texts with noise inside, lost words and swapped words: as many as aligning every stretch finds."""
    random = np.random.default_rng(len(name))
    words = NAMES[name].split()
    rows = []
    for i in range(150):
        own = [w for w in words if random.random() > 0.12]
        for _ in range(int(random.integers(0, len(words)))):
            own.insert(int(random.integers(0, len(own) + 1)), f"n{random.integers(50)}")
        if i % 5 == 0 and len(own) > 2:
            own[0], own[-1] = own[-1], own[0]
        pad = [str(random.choice(words + ["the", "of", "zz"])) for _ in range(int(random.integers(0, 12)))]
        rows.append((i, " ".join(pad + own + pad)))
    template = licenses._hashes([NAMES[name].encode()])[0].tolist()
    want = set()
    for i, text in rows:
        got, _, _ = licenses.best_cover(licenses._hashes([text.encode()])[0].tolist(), template)
        if got >= math.ceil(licenses.COVERAGE * len(template) - 1e-9):
            want.add((i, got / len(template)))
    assert {(r.doc_id, r.coverage) for r in scan(spark, rows, [(name, NAMES[name])])} == want and want
