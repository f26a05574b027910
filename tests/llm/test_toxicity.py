"""The factorization machine: what a sum of weights cannot learn, held-out accuracy, odd rows."""

import random

import numpy as np

from mediacat.llm import toxicity as T
from mediacat.llm.queries import QUERIES
from tests.llm.fixtures import frame, text


def test_pairs_of_terms():
    """Toxic only where an insult meets a group: each alone is common in clean logs."""
    rng = random.Random(4)
    def log(insult, group):
        w = text(rng, 25).split()
        w += ["blockhead"] * insult + ["operators"] * group
        rng.shuffle(w)
        return " ".join(w)
    cases = [(i, g) for i in (0, 1) for g in (0, 1)]
    logs = [(log(i, g), int(i and g)) for _ in range(300) for i, g in cases]
    terms, lengths = T.hashed_terms([t for t, _ in logs])
    machine = T.train(np.split(terms, np.cumsum(lengths)[:-1]), np.array([y for _, y in logs], float), 30)
    score = machine.score([log(i, g) for i, g in cases for _ in range(50)]).reshape(4, 50).mean(1)
    assert score[3] > 0.8 and max(score[:3]) < 0.2


def test_factors_equal_pair_sums():
    rng = np.random.default_rng(1)
    m = T.Machine(0.3, rng.normal(size=1 << T.BITS).astype(np.float32), rng.normal(size=(1 << T.BITS, 4)).astype(np.float32))
    terms = np.array([5, 9, 77, 300])
    want = 0.3 + m.w[terms].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(terms) for b in terms[i + 1 :])
    assert abs(m.raw(terms, np.array([4]))[0] - want) < 1e-3


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scores = QUERIES["op10_factorization_machine"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = scores.where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in rows) / len(rows)
    found = [r.predicted for r in rows if r.toxic]
    assert hit > 0.96 and sum(found) / len(found) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark):
    rows = [(1, "good log"), (1, "good log"), (2, None), (None, "blockhead"), (3, ""), (4, "x " * 100_000)]
    logs = frame(spark, rows)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (7, 1), (None, 0), (3, None), (4, 5)], "job_id bigint, toxic int")
    machine = T.learn_machine(logs, labels)
    got = T.score_logs(logs, machine).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.job_id in (2, 3)}) == 1
    kept = T.without_toxic(logs, machine)
    assert kept.columns == logs.columns
    nothing = T.learn_machine(logs, labels.limit(0))
    assert {r.predicted for r in T.score_logs(logs, nothing).collect()} == {0}
    assert T.score_logs(logs.limit(0), machine).count() == 0
