"""Groups of similar logs against all pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest

from mediacat.llm import blocks as B
from mediacat.llm import jaccard
from mediacat.llm.links import components
from mediacat.llm.shared import shared_folder
from tests.llm.fixtures import frame, logs


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 4000)
    monkeypatch.setattr(jaccard, "LEAST_BUCKETS", 5)


def shingles(log):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (log or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_by_hand(rows):
    sets = {j: shingles(t) for j, t in rows}
    group = {j: j for j in sets}

    def top(j):
        while group[j] != j:
            j = group[j]
        return j

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return sorted((j, len(s), top(j)) for j, s in sets.items())


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_groups(spark, seed):
    rows = logs(seed)
    got = sorted(tuple(r) for r in jaccard.link_logs(frame(spark, rows)).collect())
    assert got == groups_by_hand(rows)
    assert sum(j != c for j, _, c in got) > 15


def test_chains_of_links(spark):
    """Each log is like the next, the ends are not alike: one group all the same."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i + 1, " ".join(w[4 * i : 4 * i + 100])) for i in range(60)]
    assert {r.component_id for r in jaccard.link_logs(frame(spark, rows)).collect()} == {1}


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (4, "A B c d e f g"), (5, "A B c d É f g"), (6, "A B c d é f g")]
    got = sorted(tuple(r) for r in jaccard.link_logs(frame(spark, rows)).collect())
    assert got == [(1, 3, 1), (4, 3, 1), (5, 3, 5), (6, 3, 6)]
    assert jaccard.link_logs(frame(spark, rows).limit(0)).count() == 0
    assert [tuple(r) for r in jaccard.link_logs(frame(spark, [(3, None)])).collect()] == [(3, 0, 3)]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (70, 60), (80, 80)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), shared_folder(spark), "c").collect()
    assert {r.node: r.component for r in got} == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50}


def counts_by_hand(rows):
    sets = {j: shingles(t) for j, t in rows}
    both = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b}
    linked = [a for (a, b), c in both.items() if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    return sorted((j, len(s), linked.count(j)) for j, s in sets.items())


@pytest.mark.parametrize("seed, tile", [(1, 512), (2, 7)])
def test_link_counts(spark, monkeypatch, seed, tile):
    """Groups of copies and different near copies, in one tile and in several: every link of every log is counted."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = logs(seed)
    got = jaccard.link_logs(frame(spark, rows), counts=True).collect()
    assert sorted((r.job_id, r.n_shingles, r.n_links) for r in got) == counts_by_hand(rows)
    assert sorted((r.job_id, r.n_shingles, r.component_id) for r in got) == groups_by_hand(rows)
    assert sum(r.n_links > 1 for r in got) > 15


def test_link_counts_of_chains_and_odd_rows(spark):
    """Links in a group whose ends are not alike; an id that repeats is one log."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i + 1, " ".join(w[4 * i : 4 * i + 100])) for i in range(60)]
    got = jaccard.link_logs(frame(spark, rows), counts=True).collect()
    assert sorted((r.job_id, r.n_shingles, r.n_links) for r in got) == counts_by_hand(rows)
    near = " ".join(w[:100])
    rows = [(1, near), (1, near), (2, near + " x"), (3, near + " y z"), (4, None), (5, near + " x")]
    got = jaccard.link_logs(frame(spark, rows), counts=True).collect()
    assert sorted((r.job_id, r.n_links) for r in got) == [(1, 3), (2, 3), (3, 3), (4, 0), (5, 3)]


@pytest.mark.parametrize("less, linked", [(0, 1), (1, 0)])
def test_long_logs_at_the_threshold(less, linked):
    """95,871 common shingles and sizes summing to 223,699 are 0.75 exactly; with one shingle less they are not."""
    common, n = 95_871 - less, 223_699
    sides = [np.arange(common), np.arange(common)]
    tile = pa.table({
        "side": [0, 1], "job_id": [1, 2], "n": pa.array([n // 2, n - n // 2], pa.int64()),
        "keys": pa.array(sides, pa.list_(pa.int64())),
    })
    assert jaccard._tile_product(tile).num_rows == linked
