"""Logs in blocks, and questions that blocks ask about the keys they hold.

A block is a few MB of logs. Its distinct keys go, sorted, to buckets by value; a bucket answers each
block with one bit for each of its keys, in the order they came. Nothing but bits comes back, and a key
that every log has is one entry for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import written

BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 128
ENTRIES = "block bigint, bucket int, keys binary, facts binary"
ANSWERS = "block bigint, bucket int, bits binary"
LAST = np.iinfo(np.int64).max


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def squeezed(texts: pa.Array) -> tuple[bytes, bytes]:
    """Lengths of the texts in bytes, -1 for NULL, and all their bytes, compressed."""
    parts = texts.cast(pa.binary()).to_pylist()
    sizes = np.array([-1 if p is None else len(p) for p in parts], "<i8")
    return sizes.tobytes(), pa.compress(b"".join(p or b"" for p in parts), "zstd", asbytes=True)


def texts_of(sizes: bytes, body: bytes) -> list[bytes | None]:
    each = np.frombuffer(sizes, "<i8")
    ends = np.cumsum(np.maximum(each, 0)).tolist()
    data = pa.decompress(body, ends[-1] if ends else 0, "zstd", asbytes=True)
    return [None if n < 0 else data[e - n : e] for n, e in zip(each.tolist(), ends)]


def in_blocks(logs: DataFrame, folder: str, job_id: str, log: str, carry: list[str] | None = None) -> DataFrame:
    """A written table of blocks: block, ids, sizes and body (the logs, see texts_of; NULLs stay), and, if
    asked, `carried`: a struct of other columns for each log, which nothing looks into."""

    limit = BLOCK_BYTES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, limit):
                ends = pa.array([0, len(part)], pa.int32())
                sizes, body = squeezed(part.column(1))
                lists = [pa.ListArray.from_arrays(ends, c) for c in [part.column(0), *part.columns[2:]]]
                packed = [pa.array([sizes], pa.binary()), pa.array([body], pa.binary())]
                yield pa.RecordBatch.from_arrays([lists[0], *packed, *lists[1:]], names=["ids", "sizes", "body", *names[2:]])

    rows = logs.select(
        F.col(job_id).cast("bigint").alias("ids"), F.col(log).alias("texts"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []),
    )
    names = rows.columns
    carried = f", carried array<{rows.schema['carried'].dataType.simpleString()}>" if carry else ""
    blocks = rows.mapInArrow(gather, f"ids array<bigint>, sizes binary, body binary{carried}")
    return written(blocks.select(F.monotonically_increasing_id().alias("block"), *blocks.columns), folder, "blocks")


def bucket_count(logs: DataFrame, log: str) -> int:
    size = logs.agg(F.sum(F.octet_length(F.col(log))).alias("bytes")).first()["bytes"] or 0
    return max(LEAST_BUCKETS, size // BUCKET_BYTES)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so sorted keys lie bucket by bucket."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Distinct:
    """The distinct keys of a block in order, with each one's lowest and highest owner.

    back: for each given key its place among the distinct ones. check: a second fingerprint that equal
    keys must share too.
    """

    def __init__(self, keys: np.ndarray, owners: np.ndarray, check: np.ndarray | None = None):
        order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
        k = keys[order]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        if check is not None:
            c = check[order]
            head[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(head)
        self.keys = k[at]
        self.check = None if check is None else c[at]
        self.back = np.empty(len(k), np.int64)
        self.back[order] = np.cumsum(head) - 1
        self.low = np.minimum.reduceat(owners[order], at) if len(at) else owners[:0]
        self.high = np.maximum.reduceat(owners[order], at) if len(at) else owners[:0]


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte plane by byte plane: the upper planes are nearly all zero
    and cost little in a compressed shuffle."""
    steps = np.diff(keys, prepend=keys.dtype.type(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def entries(
    block: int, distinct: Distinct, buckets: int, facts: np.ndarray | None = None, turn: tuple[int, int] = (0, 1)
) -> Iterator[pa.RecordBatch]:
    """A block's keys by bucket; of (turn, turns) only the buckets whose turn it is."""
    ends = np.searchsorted(bucket_of(distinct.keys, buckets), np.arange(buckets + 1))
    rows = [
        (block, b, packed_keys(distinct.keys[s:e]), b"" if facts is None else facts[s:e].tobytes())
        for b, (s, e) in enumerate(zip(ends, ends[1:])) if e > s and b % turn[1] == turn[0]
    ]
    for at in range(0, len(rows), 64):
        c = list(zip(*rows[at : at + 64]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())],
            names=["block", "bucket", "keys", "facts"],
        )


def ask(asked: DataFrame, answer: Callable[[np.ndarray, list[bytes]], list[np.ndarray]], folder: str, name: str) -> DataFrame:
    """Written table block, answers (bucket, bits): what `answer` says of all entries of each bucket.

    answer(keys, facts) gets the keys of a bucket's entries, block after block, and their facts, and
    returns rows of bits, each as long as keys.
    """

    def judge(table: pa.Table) -> pa.Table:
        keys = [unpacked_keys(k) for k in table.column("keys").to_pylist()]
        rows = answer(np.concatenate(keys), table.column("facts").to_pylist())
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        parts = zip(*[np.split(r, cuts) for r in rows])
        bits = [b"".join(np.packbits(p).tobytes() for p in own) for own in parts]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(bits, pa.binary())], names=["block", "bucket", "bits"])

    told = asked.groupBy("bucket").applyInArrow(judge, ANSWERS)
    return written(told.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), folder, name)


def answers_for(distinct: Distinct, told: list[dict] | None, buckets: int, rows: int = 1) -> list[np.ndarray]:
    """The bits that came back for a block, in the order of its distinct keys; False where nothing came."""
    out = [np.zeros(len(distinct.keys), bool) for _ in range(rows)]
    ends = np.searchsorted(bucket_of(distinct.keys, buckets), np.arange(buckets + 1))
    for t in told or []:
        s, e = ends[t["bucket"]], ends[t["bucket"] + 1]
        width = -(-(e - s) // 8)
        for r in range(rows):
            out[r][s:e] = np.unpackbits(np.frombuffer(t["bits"], np.uint8, width, r * width), count=e - s)
    return out


def held_elsewhere(keys: np.ndarray, _: list[bytes]) -> list[np.ndarray]:
    """One bit: another block has the key too."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    bits = np.zeros(len(keys), bool)
    bits[order[1:]] |= same
    bits[order[:-1]] |= same
    return [bits]
