"""Test items in logs: retrieval against scoring everything, leaks planted and absent."""

import random

import numpy as np

from mediacat.llm import decontamination as D
from mediacat.llm.queries import benchmark_items
from tests.llm.fixtures import frame, text

ITEM = "item_id bigint, question string, answer string, text string, log string"


def items(rng, n=60):
    return [(i, text(rng, rng.randrange(8, 40)), text(rng, rng.randrange(1, 6))) for i in range(n)]


def test_bounds_lose_nothing():
    """Every passage against every item gives what the blocks and bounds give."""
    rng = random.Random(1)
    index = D.build_index(items(rng))
    for _ in range(150):
        own = rng.sample(range(60), 2)
        words = D.terms(text(rng, rng.randrange(60)) + " " + " ".join(sum((list(index_text(index, i)) for i in own), [])[: rng.randrange(40)]))
        got = {(s, i) for s, _, i, _ in D.retrieve(index, words, 0.3)}
        width = max(D.PASSAGE_WORDS, 2 * index.longest)
        want = set()
        for s in range(0, max(1, len(words) - width // 2), width // 2):
            terms = sorted({index.words[w] for w in words[s : s + width] if w in index.words})
            scores = index.impact[terms].sum(0) if terms else np.zeros(60)
            want |= {(s, int(i)) for i in np.flatnonzero(scores >= 0.3)}
        assert got == want


def index_text(index, i):
    back = {n: w for w, n in index.words.items()}
    return (back[t] for t in np.flatnonzero(index.impact[:, i]))


def test_leaks(spark, monkeypatch):
    rng = random.Random(2)
    known = items(rng)
    tests = spark.createDataFrame([(i, q, a, "clash", "x") for i, q, a in known] + [(90, None, None, "", ""), (91, "", "", "", "")], ITEM)
    rows, want = [], set()
    for i in range(40):
        body = text(rng, 150)
        if i % 4 == 0:
            item = known[i % 60]
            body = body[:300] + " " + item[1] + " " + item[2] + " " + body[300:]
            want.add((i, item[0]))
        if i % 4 == 1:
            body += " " + known[i % 60][1]  # the question without its answer
        rows.append((i, body))
    rows += [(100, None), (101, ""), (102, known[3][1].upper() + "\n\n" + known[3][2]), (102, known[3][1] + " " + known[3][2])]
    logs = frame(spark, rows)
    got = [(r.job_id, r.item_id) for r in D.find_leaks(logs, tests).collect()]
    assert sorted(got) == sorted([*want, (102, 3), (102, 3)])
    monkeypatch.setattr(D, "CHUNK_ITEMS", 16)
    assert sorted((r.job_id, r.item_id) for r in D.find_leaks(logs, tests).collect()) == sorted(got)
    clean = D.without_leaks(logs, tests)
    assert clean.columns == logs.columns
    assert sorted(r.job_id for r in clean.collect()) == sorted(j for j, _ in rows if j not in {g[0] for g in got})
    assert D.find_leaks(logs.limit(0), tests).count() == 0 and D.find_leaks(logs, tests.limit(0)).count() == 0


def test_copies_without_the_last_sentence(spark, monkeypatch):
    """Where the last sentence only stands in for an answer, a copy that stops before it is a leak."""
    rng = random.Random(7)
    parts = [(i, " ".join(text(rng, 30).split()) + ".", "B" if i % 2 else "So it is " + text(rng, 4)) for i in range(40)]
    tests = spark.createDataFrame([(i, q, a, "clash", "x") for i, q, a in parts], ITEM)
    rows = [(i, text(rng, 100) + " " + parts[i][1] + " " + text(rng, 60)) for i in range(20)]
    rows += [(100 + i, text(rng, 160)) for i in range(20)]
    rows += [(200 + i, text(rng, 100) + " " + " ".join(parts[i][1].split()[:8])) for i in range(20)]
    logs = frame(spark, rows)
    want = [(i, i) for i in range(20)]
    assert sorted((r.job_id, r.item_id) for r in D.find_leaks(logs, tests, split=True).collect()) == want
    assert not {(1, 1), (3, 3)} & {(r.job_id, r.item_id) for r in D.find_leaks(logs, tests).collect()}
    monkeypatch.setattr(D, "CHUNK_ITEMS", 16)
    assert sorted((r.job_id, r.item_id) for r in D.find_leaks(logs, tests, split=True).collect()) == want
    assert {r.job_id for r in D.without_leaks(logs, tests, split=True).collect()} == {j for j, _ in rows if j >= 100}


def test_items_of_the_benchmark(spark):
    got = {r.item_id: r for r in benchmark_items(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    for i, t in texts.items():
        q, a = D.split_item(t)
        assert D.terms(got[i].question) == D.terms(q) and D.terms(got[i].answer) == D.terms(a)


def test_chunks_change_no_figure(spark, monkeypatch):
    """Items of different lengths, copied in part so that scores lie about the threshold: all columns are the same."""
    rng = random.Random(5)
    known = [(i, text(rng, rng.randrange(8, 90)), text(rng, rng.randrange(1, 9))) for i in range(70)]
    tests = spark.createDataFrame([(i, q, a, "clash", "x") for i, q, a in known] + [(90, None, None, "", ""), (91, "", "", "", "")], ITEM)
    rows = []
    for i in range(210):
        words = (known[i % 70][1] + " " + known[i % 70][2]).split()
        part = words[int(len(words) * rng.uniform(0.2, 0.5)) :]
        rows.append((i, text(rng, 120) + " " + " ".join(part) + " " + text(rng, 90)))
    logs = frame(spark, rows)
    whole = sorted(map(tuple, D.find_leaks(logs, tests).collect()))
    assert 20 < len(whole) < 210
    monkeypatch.setattr(D, "CHUNK_ITEMS", 30)
    assert sorted(map(tuple, D.find_leaks(logs, tests).collect())) == whole
    assert sorted(r.job_id for r in D.without_leaks(logs, tests).collect()) == sorted({j for j, _ in rows} - {r[0] for r in whole})
