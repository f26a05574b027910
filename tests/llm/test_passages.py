"""Removed passages and byte strings against brute force."""

import hashlib
import re

import pytest

from mediacat.llm import blocks as B
from mediacat.llm import passages, suffixes
from tests.llm.fixtures import frame, logs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(B, "LEAST_BUCKETS", 7)


def passages_by_hand(rows):
    first, words = {}, [(j, WORD.findall((t or "").encode())) for j, t in rows]
    for j, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, j), j)
    out = []
    for j, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < j:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((j, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages(spark, seed):
    rows = logs(seed)
    got = passages.remove_repeats(frame(spark, rows)).collect()
    assert sorted(tuple(r)[:4] for r in got) == passages_by_hand(rows)
    assert sum(r.n_removed for r in got) > 1000
    texts = dict(rows)
    assert all(r.kept == texts[r.job_id] for r in got if r.n_removed == 0)


def test_repeated_rows_ids_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, long), (9, "x " + long), (None, long), (3, None)]
    got = passages.remove_repeats(frame(spark, rows), carry=["keys", "n"]).collect()
    assert sorted((r.job_id or 99, r.n_removed) for r in got) == [(3, 0), (5, 0), (5, 0), (9, 40), (99, 40)]
    assert all(r.carried.keys == "k" and r.carried.n == 7 for r in got)
    assert passages.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def suffixes_by_hand(rows):
    data = [(j, (t or "").encode()) for j, t in rows]
    seen = {}
    for _, b in data:
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    out = []
    for j, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((j, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [4, 5])
def test_suffixes(spark, seed):
    rows = logs(seed, 60) + [(900, "é" * 350 + "q" * 401), (901, "z" + "é" * 350), (902, "ab" * 199 + "abc"), (None, "ab" * 200)]
    got = suffixes.remove_long_repeats(frame(spark, rows)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == suffixes_by_hand(rows)
    assert sum(r.n_removed > 0 for r in got) > 20
    for r in got:
        raw = (dict(rows)[r.job_id] or "").encode()
        cut = b"".join(raw[a:b] for a, b in zip([0, *r.span_ends], [*r.span_starts, len(raw)]))
        assert bytes(r.kept) == cut
    assert suffixes.remove_long_repeats(frame(spark, rows).limit(0)).count() == 0


def test_repeated_rows_are_copies(spark):
    got = suffixes.remove_long_repeats(frame(spark, [(1, "x" * 300 + "y" * 200), (1, "x" * 300 + "y" * 200), (2, "x" * 399)])).collect()
    assert sorted((r.job_id, r.n_removed) for r in got) == [(1, 500), (1, 500), (2, 0)]


def test_the_cover_is_one():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
