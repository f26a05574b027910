"""Repaired exchanges against a search over all edits, in one piece and spread over tasks and blocks."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mediacat.llm import exchanges as E
from mediacat.llm.queries import QUERIES

VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def hurt(rows):
    """conv_id, turn, role, text -> lines by conversation after damage."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        lines = out[c]
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        lines += [(t, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def by_hand(lines):
    """Figures, and the cheapest edits by a search that takes the ASCII-least of equally dear ones. lines are in order."""
    turns = [t for t, _, _ in lines if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in lines:
        letters = VISIBLE.findall(text)
        faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    firsts = [r[:1] for _, r, _ in lines]
    illegal = sum((a, b) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(firsts, firsts[1:]))
    heap, closed = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, said, out = heapq.heappop(heap)
        if at == len(lines) and re.fullmatch("(s?(ua)+)?", said):
            break
        state = (at, said[-2:] if len(said) > 1 else said)
        if state in closed:
            continue
        closed.add(state)
        ways = [(2, "I", at, r, f"{r}:") for r in ("user", "assistant")]
        if at < len(lines):
            _, role, text = lines[at]
            ways.append((3, "D", at + 1, None, None))
            if faults[at] not in ("blank", "duplicate"):
                short = faults[at] == "truncated"
                ways.append((short, "K", at + 1, role, f"{role}:{text}"))
                ways += [(2 + short, "R", at + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for price, edit, then, role, line in ways:
            more = said if role is None else said + (role[:1] or "?")
            if re.fullmatch("(s?(ua)*u?)?", more):
                heapq.heappush(heap, (cost + price, audit + edit, then, more, out if line is None else out + (line,)))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


def dialogue(rng, conv, n):
    roles = ["system"] * (rng.random() < 0.4) + ["user", "assistant"] * n
    words = ["Node asks.", "Lease given!", "ok", " ", "", "Why?", "stalled\n", "again.", None]
    return [(conv, t + rng.choice([0, 0, 0, 1]) * 100, rng.choice([roles[t]] * 6 + ["user", "server", None, ""]), rng.choice(words) if rng.random() < 0.5 else f"line {t}{rng.choice('.!?,')}") for t in range(n)]


def answers(spark, rows, **more):
    # one row a turn: equal turns stand in an order of hashes, which the search need not know
    once = list({(r[0], r[1]): r for r in rows}.values())
    random.Random(4).shuffle(once)
    table = spark.createDataFrame([(*r, "x", 1) for r in once], "conv_id bigint, turn bigint, role string, text string, part string, block int")
    got = E.exchange_digests(E.repair_exchanges(E.damaged(table, "conv_id", "turn", "role", "text"), **more)).collect()
    lines = hurt(sorted(once, key=lambda r: (r[1] is not None, r[1] or 0)))
    return {r["job_id"]: tuple(r[c] for c in FIGURES) for r in got}, {c: by_hand(x) for c, x in lines.items()}, len(got)


@pytest.mark.parametrize("block_lines", [4096, 3])
def test_small_exchanges(spark, block_lines):
    rng = random.Random(block_lines)
    rows = [r for c in range(200) for r in dialogue(rng, c, rng.randrange(1, 9))] + [(None, 1, "user", "Hm?"), (None, None, "assistant", "No.")]
    got, want, n = answers(spark, rows, block_lines=block_lines)
    assert got == want and n == len(want)


def test_one_exchange_has_most_lines(spark):
    """Blocks of one exchange in all tasks: edits, counts and text as if it were whole."""
    rng = random.Random(9)
    rows = dialogue(rng, 7, 900) + [r for c in range(20, 40) for r in dialogue(rng, c, 6)]
    for block_lines in (50, 7):
        got, want, _ = answers(spark, rows, block_lines=block_lines)
        assert got == want


def test_checkpoints_do_not_change_the_walk():
    rng = random.Random(5)
    end = E._settled(list(E.END))
    for n in (0, 1, 2, 50, 700):
        codes = bytes(rng.randrange(12) for _ in range(n))
        costs = [end]
        for code in reversed(codes):
            costs.append(E._before(code, costs[-1]))
        audit, state = E.cheapest_edits(codes, E.NOTHING, end, True)
        assert E._price(codes, audit) == costs[-1][E.NOTHING] and state in (E.NOTHING, E.ANSWERED)
        for cut in range(0, n, 97):
            after = E.costs_before(codes[cut:], end)
            head, mid = E.cheapest_edits(codes[:cut], E.NOTHING, after, False)
            tail, _ = E.cheapest_edits(codes[cut:], mid, end, True)
            assert head + tail == audit


def test_odd_lines(spark):
    """No lines, NULL sides and lines, equal numbers, a long line, all lines dropped; project names of the sides."""
    sides = E.Sides("library", "node", "server")
    rows = [
        (1, 1, "library", "Scan me."), (1, 2, "node", "Lease?"), (1, 3, "server", "Job 5."), (2, None, None, None),
        (3, 1, "node", "x" * 3_000_000 + "."), (3, 1, "server", "Yes."), (3, 1, "server", "Yes."), (4, 5, None, "Who?"), (4, 6, "node", None),
        (None, 1, "node", "Here."),
    ]
    table = spark.createDataFrame(rows, "job_id bigint, line_no bigint, side string, line string")
    got = {r["job_id"]: r for r in E.exchange_digests(E.repair_exchanges(table, sides=sides)).collect()}
    assert (got[1]["audit"], got[1]["cost"]) == ("KKK", 0)
    assert (got[2]["audit"], got[2]["cost"], got[2]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert (got[3]["audit"], got[3]["duplicate"], got[3]["illegal"]) == ("KKD", 1, 1)
    assert (got[4]["audit"], got[4]["blank"]) == ("DD", 1)
    assert (got[None]["audit"], got[None]["cost"]) == ("KI", 2)
    assert E.repair_exchanges(table.limit(0)).count() == 0
    repaired = {r["job_id"]: r["repaired"] for r in E.repair_exchanges(table, sides=sides).collect()}
    assert repaired[1] == "library:Scan me.\nnode:Lease?\nserver:Job 5."


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = sorted((tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()), key=lambda r: r[1])
    got = QUERIES["op11_checkpointed_repair"](spark, folder).orderBy(F.col("conv_id")).collect()
    want = hurt(rows)
    assert [r["conv_id"] for r in got] == sorted(want)
    for r in got:
        assert tuple(r[c] for c in FIGURES) == by_hand(want[r["conv_id"]]), r["conv_id"]
    assert len({r["cost"] for r in got}) > 3
