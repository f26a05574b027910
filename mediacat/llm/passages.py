"""Passages that job logs repeat from earlier jobs' logs, found by doubling window lengths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from mediacat.llm import blocks as B
from mediacat.llm.shared import shared_folder
from mediacat.llm.words import Words, covered, spans

WINDOW = 13
HALF = (WINDOW + 1) // 2
CLEANED = "job_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


class Block:
    """A block's words, and the windows that each level looks at."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]):
        self.ids = np.array([B.LAST if i is None else i for i in ids], np.int64)
        self.words = Words(texts)
        self.hashes = self.words.hashes()

    def half_windows(self) -> tuple[np.ndarray, B.Distinct]:
        """First level: half-length windows. Of the halves in a whole window only that with the smallest
        fingerprint is looked at: equal whole windows have it in the same place."""
        n, text = len(self.hashes), self.words.text
        if n < WINDOW:
            at = np.zeros(0, np.int64)
            return at, B.Distinct(np.zeros(0, np.uint64), at)
        every = spans(self.hashes, np.arange(n - HALF + 1), np.arange(HALF, n + 1), 1)
        whole = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
        chosen = np.zeros(len(every), bool)
        chosen[whole + sliding_window_view(every, WINDOW - HALF + 1)[whole].argmin(axis=1)] = True
        at = np.flatnonzero(chosen)
        return at, B.Distinct(every[at], self.words.text[at])

    def windows(self, halves: np.ndarray) -> tuple[np.ndarray, B.Distinct]:
        """Second level: whole windows around halves that other logs have; owners are job ids."""
        n, text = len(self.hashes), self.words.text
        near = covered(n, np.maximum(halves - (WINDOW - HALF), 0), WINDOW - HALF + 1) if n else np.zeros(0, bool)
        at = np.flatnonzero(near[: max(0, n - WINDOW + 1)])
        at = at[text[at] == text[at + WINDOW - 1]]
        keys = spans(self.hashes, at, at + WINDOW, 2)
        check = (spans(self.hashes, at, at + WINDOW, 3) >> np.uint64(32)).astype("<u4")
        return at, B.Distinct(keys, self.ids[text[at]], check)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, dict]]:
    for batch in batches:
        for i in range(len(batch)):
            row = {n: c[i].values if n == "carried" else c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
            row["texts"] = B.texts_of(row.pop("sizes"), row.pop("body"))
            yield row["block"], Block(row["ids"], row["texts"]), row


def _shared_halves(block: Block, told: list[dict] | None, buckets: int) -> np.ndarray:
    at, distinct = block.half_windows()
    (elsewhere,) = B.answers_for(distinct, told, buckets)
    return at[(elsewhere | (distinct.low != distinct.high))[distinct.back]]


def _first_owner(keys: np.ndarray, facts: list[bytes]) -> list[np.ndarray]:
    """Bits: a smaller job id has the window; another block has it."""
    facts = np.frombuffer(b"".join(facts), [("check", "<u4"), ("low", "<i8")])
    order = np.lexsort((facts["low"], facts["check"], keys))
    k, c, low = keys[order], facts["check"][order], facts["low"][order]
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    later, other = np.zeros(len(k), bool), np.zeros(len(k), bool)
    later[order] = low > low[at][group]
    other[order] = np.diff(np.append(at, len(k)))[group] > 1
    return [later, other]


def remove_repeats(
    logs: DataFrame, job_id: str = "job_id", log: str = "log", carry: list[str] | None = None
) -> DataFrame:
    """Job logs without passages of 13 words or more that a smaller job id's log has.

    Words are runs of bytes other than space and 9 to 13. Windows are doubled level by level: those of
    seven words that only one log has are out; the others alone are extended to 13 words (twice seven, one
    word shared). A word goes when a 13-word window over it also starts in a log with a smaller job id, by
    the input, not by what is left. Each level asks one bit for each distinct window of a block of logs,
    so a passage that a third of all logs share is one entry for each block.

    Windows are compared by fingerprints of 96 bits. NULL and empty logs keep nothing and lose nothing;
    logs with the same id do not count as earlier than each other; a NULL id is later than all others; no
    rows give no rows. Other columns are not looked at; those named in `carry` come back in a struct
    `carried`. Returns job_id, n_words, n_removed, kept_sha256 (of the words left, one space between
    them), kept (the same words; the log as it was, with its blanks, if it loses none).
    """
    spark = logs.sparkSession
    folder = shared_folder(spark)
    buckets = B.bucket_count(logs, log)
    rows = B.in_blocks(logs, folder, job_id, log, carry)
    bare = rows.drop("carried")

    def ask_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, _ in _rows(batches):
            yield from B.entries(number, block.half_windows()[1], buckets)

    halves = B.ask(bare.mapInArrow(ask_halves, B.ENTRIES), B.held_elsewhere, folder, "halves")

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, row in _rows(batches):
            _, distinct = block.windows(_shared_halves(block, row["halves"], buckets))
            facts = np.zeros(len(distinct.keys), [("check", "<u4"), ("low", "<i8")])
            facts["check"], facts["low"] = distinct.check, distinct.low
            yield from B.entries(number, distinct, buckets, facts)

    halves = halves.withColumnRenamed("answers", "halves")
    windows = B.ask(bare.join(halves, "block", "left").mapInArrow(ask_windows, B.ENTRIES), _first_owner, folder, "windows")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, row in _rows(batches):
            at, distinct = block.windows(_shared_halves(block, row["halves"], buckets))
            later, _ = B.answers_for(distinct, row["windows"], buckets, 2)
            own = block.ids[block.words.text[at]]
            gone = covered(len(block.hashes), at[later[distinct.back] | (own > distinct.low[distinct.back])], WINDOW)
            yield from _kept(row, block.words, gone)

    both = rows.join(halves, "block", "left").join(windows.withColumnRenamed("answers", "windows"), "block", "left")
    carried = f", carried {rows.schema['carried'].dataType.elementType.simpleString()}" if carry else ""
    return both.mapInArrow(clean, CLEANED + carried)


def _kept(row: dict, words: Words, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids, texts = row["ids"], row["texts"]
    totals = np.concatenate([[0], np.cumsum(gone)])
    lost = totals[words.first[1:]] - totals[words.first[:-1]]
    stay = (~gone).tolist()
    for at in range(0, len(ids), 500):
        kept, prints = [], []
        for i in range(at, min(at + 500, len(ids))):
            own = (texts[i] or b"").split()
            left = b" ".join(compress(own, stay[words.first[i] : words.first[i + 1]]) if lost[i] else own)
            prints.append(hashlib.sha256(left).hexdigest())
            kept.append(left if lost[i] else texts[i])
        part = slice(at, at + 500)
        columns = {
            "job_id": pa.array(ids[part], pa.int64()), "n_words": pa.array(words.counts[part].astype(np.int64)),
            "n_removed": pa.array(lost[part].astype(np.int64)), "kept_sha256": pa.array(prints, pa.string()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        if "carried" in row:
            columns["carried"] = row["carried"][part]
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
