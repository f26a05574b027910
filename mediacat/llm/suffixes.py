"""Long byte strings that job logs repeat, by suffixes sorted bucket by bucket with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mediacat.llm import blocks as B
from mediacat.llm.shared import shared_folder
from mediacat.llm.words import covered, spans

LENGTH = 400
#: The suffixes' buckets are sorted in so many turns, one range of them at a time.
TURNS = 2
#: A perfect difference cover: every number modulo PERIOD is the difference of two of these.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
#: The two samples that equal strings have at the same place, within the first PERIOD bytes, reach this far at least.
REACH = LENGTH - PERIOD + 1

CLEANED = (
    "job_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary,"
    " span_starts array<bigint>, span_ends array<bigint>"
)
LISTS = pa.list_(pa.int64())
ARROW = pa.schema([
    ("job_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("kept", pa.binary()), ("span_starts", LISTS), ("span_ends", LISTS),
])


class Block:
    """The bytes of a block's logs, one after another. start, end: of each byte's own log."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]):
        parts = [t or b"" for t in texts]
        self.ids, self.data = ids, b"".join(parts)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.values = np.frombuffer(self.data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.start = np.repeat(self.first[:-1], self.sizes)
        self.end = np.repeat(self.first[1:], self.sizes)

    def sample(self) -> tuple[np.ndarray, B.Distinct]:
        """Cover places of each log, with the REACH bytes that follow."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        place = np.arange(len(self.data))
        at = np.flatnonzero(cover[(place - self.start) % PERIOD] & (place + REACH <= self.end))
        return at, B.Distinct(spans(self.values, at, at + REACH, 0), at)

    def suffixes(self, tied: np.ndarray) -> tuple[np.ndarray, B.Distinct]:
        """Suffixes, by their first LENGTH bytes, that have a tied sample in their first PERIOD bytes."""
        n = len(self.data)
        near = covered(n, np.maximum(tied - (PERIOD - 1), 0), PERIOD) if n else np.zeros(0, bool)
        at = np.flatnonzero(near & (np.arange(n) + LENGTH <= self.end))
        check = (spans(self.values, at, at + LENGTH, 1) >> np.uint64(48)).astype("<u2")
        return at, B.Distinct(spans(self.values, at, at + LENGTH, 0), at, check)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, dict]]:
    for batch in batches:
        for i in range(len(batch)):
            row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
            yield row["block"], Block(row["ids"], B.texts_of(row["sizes"], row["body"])), row


def _tied_sample(block: Block, told: list[dict] | None, buckets: int) -> np.ndarray:
    at, distinct = block.sample()
    (elsewhere,) = B.answers_for(distinct, told, buckets)
    return at[(elsewhere | (distinct.low != distinct.high))[distinct.back]]


def _tied(keys: np.ndarray, facts: list[bytes]) -> list[np.ndarray]:
    """One bit: another block has the suffix's first LENGTH bytes too."""
    check = np.frombuffer(b"".join(facts), "<u2")
    order = np.lexsort((check, keys))
    same = (keys[order][1:] == keys[order][:-1]) & (check[order][1:] == check[order][:-1])
    bits = np.zeros(len(keys), bool)
    bits[order[1:]] |= same
    bits[order[:-1]] |= same
    return [bits]


def remove_long_repeats(logs: DataFrame, job_id: str = "job_id", log: str = "log") -> DataFrame:
    """Job logs without bytes that lie in a 400-byte string found a second time in any log, itself included.

    Suffixes are put in order bucket by bucket, as far as 400 bytes. First the suffixes at the places of a
    difference cover, a twelfth of all: their order up to 268 bytes says which of them tie. Two equal
    400-byte strings have a sampled place at the same distance, below 133, from their starts, and those
    samples tie; so any suffix without a tied sample close by is settled, and only the rest is sorted, one
    bucket of keys at a time, where ties are the repeats. Memory is a block or a bucket, each of a few MB;
    between them go keys and bits, never texts; and buckets are taken in TURNS, so that a part of the
    suffixes is on disk at a time. A string that a third of all logs share is one key
    for each block.

    Strings are compared by 80-bit fingerprints; any order that puts equal strings together serves. Strings
    never cross logs; overlapping ones count; all is judged on the input. NULL is empty; logs below 400
    bytes lose nothing; repeated rows are copies of each other; no rows give no rows; other columns are not
    looked at. Returns job_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes
    left: a character may be cut), span_starts and span_ends.
    """
    folder = shared_folder(logs.sparkSession)
    buckets = B.bucket_count(logs, log)
    rows = B.in_blocks(logs, folder, job_id, log)

    def ask_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, _ in _rows(batches):
            yield from B.entries(number, block.sample()[1], buckets)

    sample = B.ask(rows.mapInArrow(ask_sample, B.ENTRIES), B.held_elsewhere, folder, "sample")

    known = rows.join(sample.withColumnRenamed("answers", "sample"), "block", "left")

    def ask_suffixes(turn: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, block, row in _rows(batches):
                _, distinct = block.suffixes(_tied_sample(block, row["sample"], buckets))
                yield from B.entries(number, distinct, buckets, distinct.check, (turn, TURNS))

        return ask

    ties = known
    for turn in range(TURNS):
        told = B.ask(known.mapInArrow(ask_suffixes(turn), B.ENTRIES), _tied, folder, f"suffixes{turn}")
        ties = ties.join(told.withColumnRenamed("answers", f"turn{turn}"), "block", "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, row in _rows(batches):
            at, distinct = block.suffixes(_tied_sample(block, row["sample"], buckets))
            told = [t for turn in range(TURNS) for t in row[f"turn{turn}"] or []]
            (elsewhere,) = B.answers_for(distinct, told, buckets)
            again = at[(elsewhere | (distinct.low != distinct.high))[distinct.back]]
            yield from _kept(block, covered(len(block.data), again, LENGTH) if len(block.data) else np.zeros(0, bool))

    return ties.mapInArrow(clean, CLEANED)


def _kept(block: Block, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw = np.frombuffer(block.data, np.uint8)
    out = []
    for i, (name, a, b) in enumerate(zip(block.ids, block.first.tolist(), block.first[1:].tolist())):
        own = gone[a:b]
        if own.any():
            kept = raw[a:b][~own].tobytes()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            starts, ends = edges[0::2].tolist(), edges[1::2].tolist()
        else:
            kept, starts, ends = block.data[a:b], [], []
        out.append((name, b - a, b - a - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept, starts, ends))
        if len(out) == 500 or i == len(block.ids) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
            out = []
