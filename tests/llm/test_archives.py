"""Lookup answers to WARC archives and back, whole and damaged."""

import random

import pytest

from mediacat.llm import archives as A

ANSWERS = [("1", "http://t/1", "x" * 120), ("2", None, "x" * 120), ("3", "http://t/3 ü\r\nx", ""), ("4", "u", None), ("5", "u", "é" * 60)]


def packed(n=6):
    return [A.member(A.record(str(i), "http://t", bytes([65 + i]) * 200, None, "1970-01-01T00:00:00Z")) for i in range(n)]


def test_round_trip(spark):
    rows = spark.createDataFrame(ANSWERS, "key string, url string, value string")
    got = {r.key: r for r in A.archive_lookups(rows.withColumn("kind", rows.url)).collect()}
    assert len(got) == 5 and {k: r.kind for k, r in got.items()} == {"1": "response", "2": "revisit", "3": "response", "4": "response", "5": "response"}
    assert got["2"].refers_to == "1" and got["2"].payload_bytes == 120
    for key, _, value in ANSWERS:
        payload = (value or "").encode()
        assert got[key].payload_digest == A.digest(payload) and got[key].payload_bytes == len(payload)
        assert got[key].kind == "revisit" or got[key].value == (value or "")


def test_numeric_keys_and_empty_table(spark):
    rows = spark.createDataFrame([(10, "u", "y" * 100), (9, "u", "y" * 100), (9, "u", "y" * 100), (None, "u", "z")], "key bigint, url string, value string")
    got = sorted((r.key, r.kind, r.refers_to) for r in A.archive_lookups(rows).collect())
    assert got == [("", "response", None), ("10", "revisit", "9"), ("9", "response", None), ("9", "response", None)]
    assert A.archive_lookups(rows.limit(0)).count() == 0


@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "drop"])
def test_salvage_compressed(damage):
    parts = packed()
    if damage == "flip":
        parts[2] = parts[2][:30] + bytes([parts[2][30] ^ 255]) + parts[2][31:]
    elif damage == "cut":
        parts[2] = parts[2][:25]
    elif damage == "junk":
        parts.insert(2, A.GZIP + b"junk" * 9)
    else:
        parts[5] = parts[5][:-9]
    data = b"".join(parts)
    found = list(A.salvage(data))
    gaps = [(a, b) for a, b, r in found if r["kind"] == "gap"]
    keys = [r["key"] for _, _, r in found if r["kind"] != "gap"]
    assert len(gaps) == 1
    assert keys == {"flip": list("01345"), "cut": list("01345"), "junk": list("012345"), "drop": list("01234")}[damage]
    assert sum(b - a for a, b, _ in found) == len(data) and [a for a, _, _ in found[1:]] == [b for _, b, _ in found[:-1]]


def test_salvage_plain_at_random():
    rng = random.Random(3)
    parts = [A.record(str(i), "u", bytes(rng.randrange(256) for _ in range(rng.randrange(300))), None, "d") for i in range(20)]
    for _ in range(40):
        broken = rng.randrange(20)
        own = bytearray(parts[broken])
        own[rng.randrange(len(own) - 4)] ^= 1 + rng.randrange(255)
        found = list(A.salvage(b"".join([*parts[:broken], bytes(own), *parts[broken + 1 :]])))
        keys = [r["key"] for _, _, r in found if r["kind"] != "gap"]
        assert set(map(str, set(range(20)) - {broken})) <= set(keys)
    assert list(A.salvage(b"")) == []
    assert [r["kind"] for _, _, r in A.salvage(b"nothing here")] == ["gap"]


def plain(i, payload):
    return A.record(str(i), "u", payload, None, "d")


def keys_and_gaps(data):
    found = list(A.salvage(data))
    return [r["key"] for _, _, r in found if r["kind"] != "gap"], [(a, b) for a, b, r in found if r["kind"] == "gap"]


def test_a_plain_archive_with_a_damaged_head_and_gzip_payloads():
    bodies = [A.member(bytes([65 + i]) * 300) for i in range(4)]
    parts = [plain(i, b) for i, b in enumerate(bodies)]
    head = b"junk" + parts[0][4:]
    assert keys_and_gaps(head + b"".join(parts[1:])) == (["1", "2", "3"], [(0, len(head))])
    assert keys_and_gaps(b"\0" * 50 + b"".join(parts)) == (["0", "1", "2", "3"], [(0, 50)])


def test_members_and_plain_records_in_one_archive():
    two = A.member(plain(1, b"b") + plain(2, b"c" * 200))
    broken = bytearray(plain(4, b"e" * 50))
    broken[-20] ^= 1
    mixed = A.member(plain(3, b"d") + bytes(broken) + plain(5, b"f"))
    data = plain(0, b"a") + two + b"??" + mixed + plain(6, b"g")
    found = list(A.salvage(data))
    assert [r.get("key", "gap") for _, _, r in found] == ["0", "1", "2", "gap", "3", "gap", "5", "6"]
    at = len(plain(0, b"a"))
    assert {(a, b) for a, b, r in found if r.get("key") in ("1", "2")} == {(at, at + len(two))}
    assert len({(a, b) for a, b, r in found[4:7]}) == 1 and found[3][:2] == (at + len(two), at + len(two) + 2)
    assert keys_and_gaps(A.member(bytes(broken)))[1] and keys_and_gaps(A.member(b"") + plain(1, b"")) == (["1"], [(0, len(A.member(b"")))])


@pytest.mark.parametrize("window", [11, 64, 1000])
def test_windows_of_any_size_find_the_same(window, monkeypatch):
    rng = random.Random(window)
    parts = [f(plain(i, rng.randbytes(rng.randrange(700)))) for i, f in enumerate(rng.choices([A.member, bytes], k=30))]
    data = bytearray(b"".join(parts))
    for _ in range(5):
        data[rng.randrange(len(data))] ^= 255
    whole = list(A.salvage(bytes(data)))
    monkeypatch.setattr(A, "WINDOW", window)
    assert list(A.salvage(bytes(data))) == whole
    assert 25 <= sum(r["kind"] != "gap" for _, _, r in whole) < 30
    assert sum({(a, b): b - a for a, b, _ in whole}.values()) == len(data)


def test_a_long_archive_is_read_in_windows(monkeypatch):
    """No read is longer than a window or a record, also where damage made a length as long as the file."""
    monkeypatch.setattr(A, "WINDOW", 1 << 16)
    parts = [plain(i, b"z" * 5000) for i in range(2000)]
    parts[7] = parts[7].replace(b"Content-Length: 5", b"Content-Length: 9000005", 2)
    data, reads = b"".join(parts), []

    class File:
        def size(self):
            return len(data)

        def read_at(self, n, at):
            reads.append(n)
            return data[at : at + n]

    found = [r for _, _, r in A.salvage(File())]
    assert [r["key"] for r in found if r["kind"] != "gap"] == [str(i) for i in range(2000) if i != 7]
    assert max(reads) == 1 << 16 and sum(reads) < 1.3 * len(data)
