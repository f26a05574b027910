"""Licence notices: planted in logs, calibrated and confirmed."""

import pytest
from pyspark.sql import functions as F

from mediacat.llm import licences as L
from tests.llm.fixtures import frame, logs


@pytest.fixture(scope="module")
def classifier(spark):
    return L.learn_licences(spark, L.paragraphs_of(frame(spark, logs(1))))


NOTICES = [
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("ALL RIGHTS RESERVED", "proprietary"),
    ("Licensed under CC BY-NC 4.0.", "creative_commons"), ("Released under the BSD licence.", "bsd"),
]


def test_planted_notices(spark, classifier):
    clean = [(j, t) for j, t in logs(2)]
    planted = [(1000 + i, f"frame one\n\n{notice}\nqueue two") for i, (notice, _) in enumerate(NOTICES)]
    found = L.scan_licences(frame(spark, clean + planted), classifier).collect()
    got = {(r.job_id, r.paragraph_no): r.family for r in found if r.confirmed}
    assert got == {(1000 + i, 2): family for i, (_, family) in enumerate(NOTICES)}


def test_near_misses_are_unknown(spark, classifier):
    rows = [(1, "the licensed software was without restriction for any person"), (2, "public work version")]
    found = L.scan_licences(frame(spark, rows), classifier).collect()
    assert all(r.family == "unknown" and not r.confirmed for r in found)


def test_cue_words_lose_nothing(spark, classifier):
    """Scoring every paragraph finds what scoring those with a cue word finds."""
    rows = logs(3) + [(2000 + i, n) for i, (n, _) in enumerate(NOTICES)] + [(3000, "of the to"), (3001, "this in and or are that")]
    cued = {(r.job_id, r.paragraph_no) for r in L.scan_licences(frame(spark, rows), classifier).collect()}
    every = L.LicenceClassifier(classifier.vectors, classifier.model, classifier.least, [])
    assert {(r.job_id, r.paragraph_no) for r in L.scan_licences(frame(spark, rows), every).collect()} == cued


def test_words_and_templates_agree(spark):
    for texts in L.TEMPLATES.values():
        for t in texts:
            assert spark.range(1).select(L.grams(L.words(F.lit(t))).alias("g")).first().g == L.template_grams(t)


def test_odd_rows(spark, classifier):
    rows = [(1, None), (2, ""), (3, "All rights reserved."), (3, "All rights reserved."), (None, "All rights reserved."), (4, "x" * 200_000 + "\nAll rights reserved.")]
    got = L.scan_licences(frame(spark, rows), classifier).collect()
    assert sorted((r.job_id or 0, r.paragraph_no) for r in got) == [(0, 0), (3, 0), (3, 0), (4, 1)]
    assert L.scan_licences(frame(spark, rows).limit(0), classifier).count() == 0
