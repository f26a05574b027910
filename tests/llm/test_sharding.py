"""Shards: sizes, slots, copies together, hot texts."""

import zlib

from mediacat.llm import sharding
from tests.llm.fixtures import frame, logs


def shards(spark, rows):
    got = sharding.shard_logs(frame(spark, rows)).collect()
    assert sorted((r.job_id is None, r.job_id) for r in got if r.job_id is not None) == sorted((False, j) for j, _ in rows if j is not None)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return got


def test_sizes_and_copies(spark):
    rows = [(j + 1000 * k, None if t is None else f"{t} {k}") for k in range(40) for j, t in logs(1, 60) if j != 65] + [(900_005, "again"), (900_006, "again"), (900_007, "again")]
    got = shards(spark, rows)
    texts = {j: t or "" for j, t in rows}
    assert all(r.size == len(texts[r.job_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.job_id].encode()) for r in got)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) < 1.05 * sum(sizes) / 8 and min(sizes) > 0.95 * sum(sizes) / 8
    place = {}
    for r in got:
        place.setdefault(texts[r.job_id], set()).add(r.shard)
    assert all(len(p) == 1 for p in place.values())


def test_one_hot_text_is_dealt_out(spark):
    rows = [(i, "the same long line of a log") for i in range(4000)] + [(5000 + i, f"other {i} " * 3) for i in range(6000)]
    got = shards(spark, rows)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) < 1.1 * sum(sizes) / 8 and min(sizes) > 0.9 * sum(sizes) / 8


def test_odd_rows(spark):
    assert len(shards(spark, [(1, None)])) == 1
    assert len(shards(spark, [(1, ""), (1, ""), (None, "x")])) == 3
    assert sharding.shard_logs(frame(spark, [(1, "")]).limit(0)).count() == 0
