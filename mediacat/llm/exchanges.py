"""Repair of the exchanges between a node and the server over a job, by the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import shared_folder, written

#: A block of an exchange ends at so many lines or so many characters.
BLOCK_LINES = 4096
BLOCK_CHARS = 1 << 20
KEPT_WALKS = 1 << 14

BLANKS = " \t\n\x0b\x0c\r"

REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
INFINITE = 1 << 60
#: What has been written so far: nothing, the opening, a question, an answer. All but a question ask for a question next.
NOTHING, OPENED, ASKED, ANSWERED = range(4)
END = (0, INFINITE, INFINITE, 0)
FINE, SHORT, GONE = range(3)


class Sides(NamedTuple):
    """Names of the side that may open an exchange, the one that asks and the one that answers; only the
    first letter of a line's side is looked at, so the three must differ in it."""

    opening: str = "system"
    asking: str = "user"
    answering: str = "assistant"


def damaged(lines: DataFrame, job_id: str, line_no: str, side: str, line: str, asking: str = "user") -> DataFrame:
    """Exchanges with one line in four harmed, by crc32(`job_id:line_no`) % 20: 0 drops the line, 1 empties it, 2
    takes its `.`, `!` and `?`, 3 says it twice, 4 gives it to the asking side. NULLs are one space; a NULL
    line_no stays NULL in the result. Returns job_id, line_no, side, line; a dropped line leaves a row without
    side and line, so that its exchange is still known."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(job_id).cast("string"), space), F.coalesce(F.col(line_no).cast("string"), space))
    harm, text = F.crc32(key.cast("binary")) % 20, F.coalesce(F.col(line), space)
    rows = lines.select(
        F.col(job_id).cast("bigint").alias("job_id"), F.col(line_no).cast("bigint").alias("line_no"), harm.alias("harm"),
        F.when(harm == 0, None).when(harm == 4, F.lit(asking)).otherwise(F.coalesce(F.col(side), space)).alias("side"),
        F.when(harm == 0, None).when(harm == 1, F.lit("")).when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("line"),
    )
    twice = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("job_id", "line_no", "side", "line", twice.alias("copy")).drop("copy")


def _next(state: int) -> int:
    """Where a question or answer, whichever is due, leads."""
    return ANSWERED if state == ASKED else ASKED


def _kept(code: int, state: int) -> int | None:
    """Where keeping a line leads, None if its side is not due."""
    start = code // 3
    if start == 0:
        return OPENED if state == NOTHING else None
    if start == 1:
        return ASKED if state != ASKED else None
    return ANSWERED if start == 2 and state == ASKED else None


def _settled(v: list[int]) -> tuple[int, int, int, int]:
    """Costs with lines put in before the next one."""
    asked, answered = min(v[ASKED], INSERT + v[ANSWERED]), min(v[ANSWERED], INSERT + v[ASKED])
    return min(v[NOTHING], INSERT + asked), min(v[OPENED], INSERT + asked), asked, answered


@lru_cache(maxsize=None)
def _moves(code: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """For each state the (cost, next state) of deleting, keeping and giving a line away; 12 codes in all."""
    out = []
    for state in range(4):
        ways = [(DELETE, state)]
        if code % 3 != GONE:
            short, kept = CUT_SHORT * (code % 3 == SHORT), _kept(code, state)
            ways += [(short, kept)] if kept is not None else []
            ways += [(REROLE + short, _next(state))]
        out.append(tuple(ways))
    return tuple(out)


def _before(code: int, after: tuple) -> tuple:
    """Costs before a line from those after it."""
    return _settled([min(cost + after[to] for cost, to in ways) for ways in _moves(code)])


def costs_before(codes: bytes, after: tuple) -> tuple:
    for code in reversed(codes):
        after = _before(code, after)
    return after


def cheapest_edits(codes: bytes, state: int, after: tuple, last: bool) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of a block of lines from `state` on, and the state they end in.

    codes: 3 x side (opening, asking, answering, other) + 0 fine, 1 cut short, 2 has to go. after: the cheapest
    cost of all later lines, by state. last: no line follows, so what is missing at the end is put in.

    Costs run backward, and only those at every sqrt(n)-th line are stored; walking forward, the costs within
    one such stretch are worked out again. So n lines hold 2 sqrt(n) cost vectors at a time. At each line
    the first of D, I, K, R that still reaches the least cost is taken.
    """
    size = isqrt(len(codes)) + 1
    starts = list(range(0, len(codes), size))
    stored = [after]
    for at in reversed(starts[1:]):
        stored.append(costs_before(codes[at : at + size], stored[-1]))
    edits = []
    for at in starts:
        stretch = codes[at : at + size]
        costs = [stored.pop()]
        for code in reversed(stretch):
            costs.append(_before(code, costs[-1]))
        for code in stretch:
            here, there = costs.pop(), costs[-1]
            short = CUT_SHORT * (code % 3 == SHORT)
            while True:
                kept = None if code % 3 == GONE else _kept(code, state)
                if here[state] == DELETE + there[state]:
                    edits.append("D")
                    break
                if here[state] == INSERT + here[_next(state)]:
                    edits.append("I")
                    state = _next(state)
                    continue
                if kept is not None and here[state] == short + there[kept]:
                    edits.append("K")
                    state = kept
                    break
                edits.append("R")
                state = _next(state)
                break
    while last and state not in (NOTHING, ANSWERED):
        edits.append("I")
        state = _next(state)
    return "".join(edits), state


@lru_cache(maxsize=KEPT_WALKS)
def _short_walk(codes: bytes) -> tuple[str, int]:
    return cheapest_edits(codes, NOTHING, _settled(list(END)), True)[0], costs_before(codes, _settled(list(END)))[NOTHING]


def _print(job_id: int | None, side: str, line: str) -> bytes:
    return hashlib.md5(f"{job_id}\0{side}\0{line}".encode("utf-8", "surrogatepass")).digest()


class Block:
    """Consecutive lines of one exchange."""

    def __init__(self, job_id: int | None, sides: Sides):
        self.job_id, self.order = job_id, {s[:1]: i for i, s in enumerate(sides)}
        self.names = sides
        self.line_nos, self.sides, self.lines, self.chars = [], [], [], 0

    def add(self, line_no: int | None, side: str, line: str) -> None:
        self.line_nos.append(line_no)
        self.sides.append(side)
        self.lines.append(line)
        self.chars += len(side) + len(line)

    def judge(self, earlier: set[bytes] = frozenset()) -> dict:
        """Codes and counts; earlier: prints of lines that blocks before this one have."""
        seen, codes, blank, again, cut = set(), bytearray(), 0, 0, 0
        for side, line in zip(self.sides, self.lines):
            fault = FINE
            end = line.rstrip(BLANKS)[-1:]
            if not end:
                fault, blank = GONE, blank + 1
            elif (side, line) in seen or (earlier and _print(self.job_id, side, line) in earlier):
                fault, again = GONE, again + 1
            elif end not in ".!?":
                fault, cut = SHORT, cut + 1
            seen.add((side, line))
            codes.append(3 * self.order.get(side[:1], 3) + fault)
        return {"codes": bytes(codes), "blank": blank, "duplicate": again, "truncated": cut}

    def illegal(self, before: str | None) -> int:
        """Neighbours whose sides do not follow each other; before: the first letter of the side before the block."""
        o, a, b = self.names
        right = {(o[:1], a[:1]), (a[:1], b[:1]), (b[:1], a[:1])}
        firsts = ([] if before is None else [before]) + [s[:1] for s in self.sides]
        return sum(pair not in right for pair in zip(firsts, firsts[1:]))

    def gaps(self, before: int | None) -> int:
        """Missing line numbers between neighbours; before: the number before the block."""
        numbers = ([] if before is None else [before]) + [n for n in self.line_nos if n is not None]
        return sum(max(b - a - 1, 0) for a, b in zip(numbers, numbers[1:]))

    def apply(self, audit: str, state: int) -> str:
        """The edits carried out; text of a later block begins with a line break."""
        out, at = [], 0
        began = state != NOTHING
        for edit in audit:
            if edit == "D":
                at += 1
                continue
            due = self.names.answering if state == ASKED else self.names.asking
            if edit == "I":
                out.append(f"{due}:")
                state = _next(state)
                continue
            if edit == "R":
                out.append(f"{due}:{self.lines[at]}")
                state = _next(state)
            else:
                out.append(f"{self.sides[at]}:{self.lines[at]}")
                state = _kept(3 * self.order.get(self.sides[at][:1], 3), state)
            at += 1
        return ("\n" if began and out else "") + "\n".join(out)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
WHOLE = ", ".join(f"{c} bigint" for c in FIGURES) + ", audit string, repaired string"
CUT = (
    "job_id bigint, block bigint, part boolean, " + WHOLE
    + ", line_nos array<bigint>, sides array<string>, lines array<string>, prints array<binary>"
)
LISTS = {"line_nos": pa.list_(pa.int64()), "sides": pa.list_(pa.string()), "lines": pa.list_(pa.string()), "prints": pa.list_(pa.binary())}
TYPES = {
    "job_id": pa.int64(), "block": pa.int64(), "part": pa.bool_(), **{c: pa.int64() for c in FIGURES}, "audit": pa.string(),
    "repaired": pa.string(), **LISTS, "codes": pa.binary(), "side_first": pa.string(), "side_last": pa.string(), "line_first": pa.int64(),
    "line_last": pa.int64(), "costs": pa.list_(pa.int64()), "after": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()),
    "last": pa.bool_(), "start": pa.int64(), "side_before": pa.string(), "line_before": pa.int64(), "repaired_sha256": pa.string(),
}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], TYPES[n]) for n in names], names=names)


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def _cut(sides: Sides, block_lines: int):
    """Exchanges that lie within a partition are repaired at once; those at its ends, and long ones, leave as blocks."""

    def finished(block: Block) -> dict:
        facts = block.judge()
        codes = facts.pop("codes")
        audit, cost = _short_walk(codes) if len(codes) <= 64 else (
            cheapest_edits(codes, NOTHING, _settled(list(END)), True)[0], costs_before(codes, _settled(list(END)))[NOTHING]
        )
        return facts | {
            "job_id": block.job_id, "part": False, "gaps": block.gaps(None), "illegal": block.illegal(None), "cost": cost,
            "audit": audit, "repaired": block.apply(audit, NOTHING),
        }

    def part_of(block: Block) -> dict:
        prints = list(dict.fromkeys(_print(block.job_id, s, x) for s, x in zip(block.sides, block.lines)))
        return {
            "job_id": block.job_id, "part": True, "line_nos": block.line_nos, "sides": block.sides, "lines": block.lines, "prints": prints,
        }

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, names = TaskContext.get().partitionId() << 40, _names(CUT)
        block, first, long, out, size = None, True, False, [], 0

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        def leave(row: dict, chars: int) -> Iterator[pa.RecordBatch]:
            nonlocal number, out, size
            out.append(row | {"block": number})
            number, size = number + 1, size + chars
            if size >= BLOCK_CHARS or len(out) >= 4096:
                yield _batch(out, names)
                out, size = [], 0

        for job_id, line_no, side, line in rows():
            if block is None or block.job_id != job_id:
                if block is not None:
                    yield from leave(part_of(block) if first or long else finished(block), block.chars)
                    first = False
                block, long = Block(job_id, sides), False
            elif len(block.lines) >= block_lines or block.chars >= BLOCK_CHARS:
                yield from leave(part_of(block), block.chars)
                block, long = Block(job_id, sides), True
            if side is not None or line is not None:
                block.add(line_no, side or "", line or "")
        if block is not None:
            yield from leave(part_of(block), block.chars)
        if out:
            yield _batch(out, names)

    return cut


def _blocks(batches: Iterator[pa.RecordBatch], sides: Sides) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            block = Block(row["job_id"], sides)
            for line_no, side, line in zip(row.pop("line_nos"), row.pop("sides"), row.pop("lines")):
                block.add(line_no, side, line)
            yield row, block


CODED = (
    "job_id bigint, block bigint, codes binary, blank bigint, duplicate bigint, truncated bigint, side_first string, side_last string,"
    " line_first bigint, line_last bigint, costs array<bigint>"
)


def _coded(sides: Sides):
    """Codes of each block and the cheapest cost from each state at its start to each at its end."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches, sides):
            facts = block.judge(set(row["earlier"] or ()))
            units = [tuple(0 if s == t else INFINITE for s in range(4)) for t in range(4)]
            # without lines put in at the end: the next block's costs hold those
            columns = [costs_before(facts["codes"], u) if facts["codes"] else u for u in units]
            numbers = [n for n in block.line_nos if n is not None]
            yield _batch(
                [
                    facts | {
                        "job_id": row["job_id"], "block": row["block"], "costs": [min(columns[t][s], INFINITE) for s in range(4) for t in range(4)],
                        "side_first": block.sides[0][:1] if block.sides else None, "side_last": block.sides[-1][:1] if block.sides else None,
                        "line_first": numbers[0] if numbers else None, "line_last": numbers[-1] if numbers else None,
                    }
                ],
                _names(CODED),
            )

    return code


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checkpoints: costs after each block, from the last block of an exchange to its first; one vector is held."""
    job, after = object(), None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            last = row["job_id"] != job
            if last:
                job, after = row["job_id"], _settled(list(END))
            out.append({"block": row["block"], "after": [min(a, INFINITE) for a in after], "last": last})
            after = tuple(min(row["costs"][4 * s + t] + after[t] for t in range(4)) for s in range(4))
        yield _batch(out, ["block", "after", "last"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the edits of a block end, for each state in which they may begin."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ends = [cheapest_edits(row["codes"], s, tuple(row["after"]), row["last"])[1] for s in range(4)]
            out.append(row | {"ends": ends})
        yield _batch(out, _names(ENDS))


ENDS = "job_id bigint, block bigint, after array<bigint>, last boolean, ends array<bigint>, side_first string, side_last string, line_last bigint"
STARTS = "block bigint, start bigint, side_before string, line_before bigint"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each block begins: state, side and line number of what is before it."""
    job, state, side, number = object(), NOTHING, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["job_id"] != job:
                job, state, side, number = row["job_id"], NOTHING, None, None
            out.append({"block": row["block"], "start": state, "side_before": side, "line_before": number})
            state = row["ends"][state]
            side = row["side_last"] if row["side_last"] is not None else side
            number = row["line_last"] if row["line_last"] is not None else number
        yield _batch(out, _names(STARTS))


def _carried_out(sides: Sides):
    def carry_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches, sides):
            audit, _ = cheapest_edits(row["codes"], row["start"], tuple(row["after"]), row["last"])
            done = {c: row[c] for c in ("job_id", "block", "part", "blank", "duplicate", "truncated")}
            done |= {"gaps": block.gaps(row["line_before"]), "illegal": block.illegal(row["side_before"]), "audit": audit}
            done["cost"] = _price(row["codes"], audit)
            yield _batch([done | {"repaired": block.apply(audit, row["start"])}], _names(REPAIRED))

    return carry_out


def _price(codes: bytes, audit: str) -> int:
    cost, at = 0, 0
    for edit in audit:
        cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
        if edit != "I":
            cost += CUT_SHORT * (edit != "D" and codes[at] % 3 == SHORT)
            at += 1
    return cost


REPAIRED = "job_id bigint, block bigint, part boolean, " + WHOLE


def repair_exchanges(
    lines: DataFrame, job_id: str = "job_id", line_no: str = "line_no", side: str = "side", line: str = "line",
    sides: Sides = Sides(), block_lines: int = BLOCK_LINES,
) -> DataFrame:
    """Exchanges put right by the cheapest edits: a row for each exchange, or for each block of a long one.

    An exchange is what was said over a job, a row a line, in the order of line_no (NULLs first; equal numbers by
    side, then by a hash of the line). NULL sides and lines are empty; a row without both stands for no line and
    only makes its job known. A line's first fault counts: blank (nothing but space and 9 to 13), duplicate (side
    and line said earlier), truncated (the last visible character is not `.`, `!` or `?`). Keeping a line costs 0,
    giving it to the side that is due 2, deleting it 3 (blank and duplicate lines must go), putting in an empty
    line of the due side 2; a truncated line that stays adds 1. In the end sides read `(opening? (asking
    answering)+)?` by their first letters. Of the cheapest edits the ASCII-least are taken.

    Returns job_id, block, part, gaps (missing line numbers), blank, duplicate, truncated, illegal (neighbours whose
    sides do not follow each other), cost, audit (edits' initials), repaired (`side:line`, joined by line breaks).
    Figures of an exchange are sums over its blocks, audit and text their concatenation by `block`; `exchange_digests`
    does that. NULL job ids are one exchange. No rows give no rows; other columns are not looked at.

    Lines are dealt by ranges of (job, number, ...), so one exchange may spread over all tasks. What lies within a
    task is repaired there. Of the others each block gives the costs between the four states at its two
    ends; one pass over these rows sets the costs at the block ends, the checkpoints, and a second one the states;
    then every block is walked on its own. No task holds more than a block of lines.
    """
    spark = lines.sparkSession
    folder = shared_folder(spark)
    rows = lines.select(
        F.col(job_id).cast("bigint").alias("job_id"), F.col(line_no).cast("bigint").alias("line_no"),
        F.col(side).alias("side"), F.col(line).alias("line"), F.monotonically_increasing_id().alias("salt"),
    )
    order = ["job_id", "line_no", "side", "tie"]
    rows = rows.withColumn("tie", F.xxhash64("line")).repartitionByRange(*order, "salt").sortWithinPartitions(*order, "line")
    done = rows.select("job_id", "line_no", "side", "line").mapInArrow(_cut(sides, block_lines), CUT)
    done = written(done, folder, "exchanges")
    whole, parts = done.where(~F.col("part")), done.where("part")

    said = parts.select("block", F.explode("prints").alias("print"))
    earliest = said.groupBy("print").agg(F.min("block").alias("first"))
    again = said.join(earliest, "print").where("block > first").groupBy("block").agg(F.collect_list("print").alias("earlier"))
    content = parts.select("job_id", "block", "part", "line_nos", "sides", "lines")
    judged = content.drop("part").join(again, "block", "left").select("job_id", "block", "line_nos", "sides", "lines", "earlier")
    coded = written(judged.mapInArrow(_coded(sides), CODED), folder, "coded")

    small = coded.select("job_id", "block", "costs").repartition("job_id").sortWithinPartitions("job_id", F.desc("block"))
    after = written(small.mapInArrow(_backward, "block bigint, after array<bigint>, last boolean"), folder, "checkpoints")
    known = coded.join(after, "block")
    ends = known.select("job_id", "block", "codes", "after", "last", "side_first", "side_last", "line_last").mapInArrow(_ends, ENDS)
    ends = ends.repartition("job_id").sortWithinPartitions("job_id", "block")
    starts = ends.mapInArrow(_forward, STARTS)
    pieces = content.join(known.drop("job_id"), "block").join(starts, "block").mapInArrow(_carried_out(sides), REPAIRED)
    return whole.select(*_names(REPAIRED)).unionByName(pieces)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _names(DIGESTS)
    job, sums, audit, digest = object(), None, [], None

    def row() -> dict:
        return sums | {"job_id": job, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        for r in batch.to_pylist():
            if r["job_id"] != job:
                if sums is not None:
                    yield _batch([row()], names)
                job, sums, audit, digest = r["job_id"], dict.fromkeys(FIGURES, 0), [], hashlib.sha256()
            for c in FIGURES:
                sums[c] += r[c]
            audit.append(r["audit"])
            digest.update(r["repaired"].encode("utf-8", "surrogatepass"))
    if sums is not None:
        yield _batch([row()], names)


DIGESTS = "job_id bigint, " + ", ".join(f"{c} bigint" for c in FIGURES) + ", audit string, repaired_sha256 string"


def exchange_digests(repaired: DataFrame) -> DataFrame:
    """One row for each exchange: the figures, audit and the SHA-256 of the repaired text.

    Blocks of a long exchange go by one task in their order, as a hash has to; it holds one block and the audit.
    """
    whole = repaired.where(~F.col("part")).select("job_id", *FIGURES, "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
    blocks = repaired.where("part").repartition("job_id").sortWithinPartitions("job_id", "block")
    return whole.unionByName(blocks.select("job_id", *FIGURES, "audit", "repaired").mapInArrow(_folded, DIGESTS))
