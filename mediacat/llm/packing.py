"""Job logs as token pieces, packed best-fit into sequences of a fixed length."""

from __future__ import annotations

import os
import re
import threading
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import shared_folder, written

SEQUENCE = 4096
END_ID = 1
NODE_ITEMS = 20_000
SLACK = 24
#: Runs remembered at most, and how many of the first seen, among them the frequent ones, outlast a trimming.
CACHED_RUNS, KEPT_RUNS = 400_000, 150_000
OTHER = re.compile(r"[^\x00-\u024f\u2010-\u2027]")
PLAIN = [chr(c) for c in chain(range(0x250), range(0x2010, 0x2028))]


def _listed(one: str) -> str:
    """Those of the plain signs and their lower case that `one` matches, as a class that lists them: it takes half the
    time of negations and categories."""
    return "[" + re.escape("".join(sorted({c for p in PLAIN for c in p + p.lower() if re.fullmatch(one, c)}))) + "]"


#: The tokenizer's own split of lower-case text, for the code points above.
RUNS = re.compile(f"{_listed(r'[^\W\d_²³¹¼½¾]')}+|'(?:s|t|re|ve|m|ll|d)|{_listed(r'[\d²³¹¼½¾]')}|{_listed(r'[^\w\s]|_')}+")


def _is_plain(text: str) -> bool:
    """Whether the split above holds: no other code points, no signs that are blank to one side only, and
    nothing like a special token."""
    if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return False
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not OTHER.search(text)


PIECES = "job_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PART = "struct<job_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
PART_TYPE = pa.struct(
    [("job_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
BINS = pa.schema([("filled", pa.int32()), ("full", pa.bool_()), ("parts", pa.list_(PART_TYPE))])


class _Places(dict):
    """Run to number; a run that is not there yet gets the next one."""

    def __missing__(self, run: str) -> int:
        self[run] = place = len(self)
        return place


class Tokens:
    """Token ids of texts. A run of letters, digits or signs always has the same ids, so each is encoded
    once and looked up afterwards; texts that need more than that go through the tokenizer whole."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # Runs are normal and split already: they need the model only.
        self.of_runs = Tokenizer(self.tokenizer.model)
        self.of_runs.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known = _Places()
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _trim(self) -> None:
        self.known = _Places(islice(self.known.items(), KEPT_RUNS))
        self.starts, self.lengths = self.starts[:KEPT_RUNS].copy(), self.lengths[:KEPT_RUNS].copy()
        self.ids = self.ids[: int(self.lengths.sum())].copy()

    def _learn(self) -> None:
        """Encode the runs that have a number but no ids yet."""
        runs = list(islice(self.known, len(self.starts), None))
        if not runs:
            return
        got = self.of_runs.encode(runs, is_pretokenized=True, add_special_tokens=False)
        lengths = np.bincount(np.array(got.word_ids, np.int64), minlength=len(runs))
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, np.array(got.ids, np.uint32)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED_RUNS:
            self._trim()
        runs = [RUNS.findall(t.lower()) if _is_plain(t) else None for t in texts]
        counts = np.array([len(r or ()) for r in runs], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(r for r in runs if r)), np.int64, int(counts.sum()))
        self._learn()
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[at] - ends + lengths, lengths)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = []
        for text, own, a, b in zip(texts, runs, cuts, cuts[1:]):
            whole = ids[a:b] if own is not None else self.tokenizer.encode(text, add_special_tokens=False).ids
            out.append(np.append(whole, END_ID).astype("<u4"))
        return out


_TOKENS: dict[str, Tokens] = {}
_FORGET: list[threading.Timer] = []
IDLE_S = 4.0


def tokens_of(tokenizer_file: str) -> Tokens:
    """One per Python worker, which runs task after task; see `idle`."""
    while _FORGET:
        _FORGET.pop().cancel()
    if tokenizer_file not in _TOKENS:
        _TOKENS[tokenizer_file] = Tokens(tokenizer_file)
    return _TOKENS[tokenizer_file]


def idle() -> None:
    """A task is done. Unless another begins within IDLE_S, the worker forgets its runs, so that they take no
    memory from what it does next."""
    timer = threading.Timer(IDLE_S, _TOKENS.clear)
    timer.daemon = True
    timer.start()
    _FORGET.append(timer)


def token_pieces(logs: DataFrame, tokenizer_file: str, job_id: str = "job_id", log: str = "log", length: int = SEQUENCE) -> DataFrame:
    """Each log's token ids with an end id, cut into pieces of `length`; only the last may be shorter.

    NULL is empty: one piece of one id. Returns job_id, piece, start, length, ids_crc32 (of the ids as
    little-endian 32-bit numbers).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer_file)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part, rows = batch.slice(at, 1024), []
                names = part.column(0).to_pylist()
                for name, ids in zip(names, tokens.encode([t or "" for t in part.column(1).to_pylist()])):
                    for n, start in enumerate(range(0, len(ids), length)):
                        piece = ids[start : start + length]
                        rows.append((name, n, start, len(piece), zlib.crc32(piece.tobytes())))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, PART_TYPE)], names=[f.name for f in PART_TYPE])
        idle()

    return logs.select(F.col(job_id).cast("bigint").alias("job_id"), F.col(log).alias("log")).mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest item first, each into the open bin that it leaves the least room in."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    open_rooms = 0  # bit r: some bin has exactly r left
    for i in order:
        size = sizes[i]
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            if not by_room[left]:
                open_rooms |= 1 << left
            by_room[left].append(b)
    return bins


def _packed(table: pa.Table, capacity: int) -> pa.Table:
    sizes = table.column("filled").to_pylist()
    parts = table.column("parts").to_pylist()
    bins = best_fit(sizes, capacity)
    filled = [sum(sizes[i] for i in b) for b in bins]
    return pa.table(
        [
            pa.array(filled, pa.int32()), pa.array([f >= capacity - SLACK for f in filled]),
            pa.array([[p for i in b for p in parts[i]] for b in bins], BINS.field("parts").type),
        ],
        schema=BINS,
    )


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of each sequence, with its place there."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            lists = part.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            columns = lists.flatten().flatten()
            lengths = columns[3].to_numpy()
            ends = np.cumsum(lengths)
            firsts = np.cumsum(counts) - counts
            before = np.where(firsts > 0, ends[firsts - 1], 0) if len(ends) else ends
            offset = ends - lengths - np.repeat(before, counts)
            ids = np.repeat(part.column(0).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids), pa.array(offset)],
                names=[*[f.name for f in PART_TYPE], "sequence_id", "offset"],
            )


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Token pieces in sequences of at most `capacity` ids: pieces with sequence_id and offset.

    Hierarchical best fit. Items are dealt to nodes of about NODE_ITEMS; each node packs its own and
    lets go of bins that lack at most SLACK ids. The others go up as items, a bin being one item of
    its filled length, to fewer nodes, until a round has one node. Where a round of several nodes takes less than a tenth
    away, bins over half full stay as they are, as no two of them fit together; those up to half full, at most one
    a node, still go up to meet. A node's work is bounded whatever the input, and no round needs the
    one before once it is written.

    Whole pieces fill a sequence alone. Repeated rows are packed each; no rows, no sequences.
    """
    spark = pieces.sparkSession
    folder = shared_folder(spark)
    pieces = written(pieces.select("job_id", "piece", "start", "length", "ids_crc32"), folder, "pieces")
    item = pieces.select(F.col("length").cast("int").alias("filled"), F.array(F.struct(*pieces.columns)).alias("parts"))
    whole = F.col("filled") >= capacity
    done = [item.where(whole).select("filled", F.lit(True).alias("full"), "parts")]
    waiting, left, round_no = item.where(~whole), None, 0
    while True:
        count = waiting.count() if left is None else left
        nodes = max(1, -(-count // NODE_ITEMS))
        first = F.col("parts")[0]
        dealt = waiting.select(
            "filled", "parts", F.pmod(F.xxhash64(first, F.lit(round_no)), F.lit(nodes)).alias("node")
        )
        bins = written(
            dealt.groupBy("node").applyInArrow(lambda t: _packed(t, capacity), f"filled int, full boolean, parts array<{PART}>"),
            folder, f"round{round_no}",
        )
        left = bins.where(~F.col("full")).count()
        if nodes == 1:
            done.append(bins)
            break
        up = ~F.col("full")
        if left > 0.9 * count:
            up = F.col("filled") * 2 <= capacity
            left = bins.where(up).count()
        done.append(bins.where(~up))
        waiting, round_no = bins.where(up).select("filled", "parts"), round_no + 1
    sequences = done[0]
    for d in done[1:]:
        sequences = sequences.unionByName(d)
    sequences = sequences.withColumn("sequence_id", F.monotonically_increasing_id())
    return sequences.select("sequence_id", "parts").mapInArrow(_laid_out, f"{PIECES}, sequence_id bigint, offset bigint")
