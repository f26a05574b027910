"""Test items found in job logs: BM25 over the items, with block-max bounds, each passage a query."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import shared_folder, written

TERM = re.compile(r"\w+")
K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
THRESHOLD = 0.5
OVERLAP = 0.5
GRAM = 3
PASSAGE_WORDS = 96
CHUNK_ITEMS = 500

LEAKS = (
    "job_id bigint, item_id bigint, n_passages int, first_word bigint, score double,"
    " question_overlap double, answer_overlap double"
)
ARROW = pa.schema([
    ("job_id", pa.int64()), ("item_id", pa.int64()), ("n_passages", pa.int32()), ("first_word", pa.int64()),
    ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()),
])


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


def grams(words: list[str], size: int = GRAM) -> set[tuple[str, ...]]:
    """Runs of `size` words; of a shorter text the text itself."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def held(part: set[tuple[str, ...]], words: list[str]) -> float:
    """The share of the runs in `part`, all of one length, that `words` has; 1 if there are none."""
    return len(part & grams(words, len(next(iter(part))))) / len(part) if part else 1.0


def text_grams(question: str | None, answer: str | None) -> set[tuple[str, ...]]:
    """The runs of question and answer as one text."""
    return grams(terms(question) + terms(answer))


def split_item(text: str | None) -> tuple[str, str]:
    """Question and answer of an item given as one text: the last sentence answers the rest."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if terms(p)]
    return (" ".join(parts[:-1]) or text or "", parts[-1]) if parts else ("", "")


@dataclass
class Whole:
    """What an index takes from all items, also where it holds only some: how many there are, their average
    and largest length, and in how many of them a term is."""

    n: int
    average: float
    longest: int
    frequency: dict[str, int]


@dataclass
class Index:
    """Inverted index of items in BM25 impacts, each item's own score being 1.

    Items lie in blocks of BLOCK_ITEMS. postings: per term, item and impact. block_max: the largest
    impact of a term in a block, dense over blocks. A passage's score for any item of a block is at most
    the sum of its terms' block maxima.
    """

    ids: list[int]
    words: dict[str, int]
    impact: np.ndarray  # terms x items
    block_max: np.ndarray  # terms x blocks
    most: np.ndarray  # terms
    question: list[set]
    answer: list[set]
    longest: int
    text: list[set] | None  # question and answer as one, where answers were split off


def build_index(items: list[tuple[int, str | None, str | None]], whole: Whole | None = None, split: bool = False) -> Index:
    """The index of `items`; `whole` tells of all items where these are a part of them. split: the answers were split
    off the items' texts."""
    texts = [terms(q) + terms(a) for _, q, a in items]
    words = {w: i for i, w in enumerate(sorted(set().union(*texts)))}
    n = len(items)
    length = np.array([len(t) for t in texts])
    tf = np.zeros((len(words), n), np.float32)
    for i, t in enumerate(texts):
        np.add.at(tf[:, i], [words[w] for w in t], 1)
    df = (tf > 0).sum(1)
    if whole is None:
        whole = Whole(n, sum(map(len, texts)) / max(1, n), int(length.max(initial=0)), dict(zip(words, df.tolist())))
    df = np.array([whole.frequency[w] for w in words], np.int64)
    idf = np.log1p((whole.n - df + 0.5) / (df + 0.5))
    average = max(1.0, whole.average)
    impact = idf[:, None] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    impact = impact / np.maximum(impact.sum(0), 1e-9)
    starts = np.arange(0, n, BLOCK_ITEMS)
    block_max = np.maximum.reduceat(impact, starts, axis=1) if len(words) else np.zeros((0, len(starts)))
    return Index(
        [i for i, _, _ in items], words, impact.astype(np.float32), block_max.astype(np.float32),
        block_max.max(1).astype(np.float32) if len(words) else np.zeros(0, np.float32),
        [grams(terms(q)) for _, q, _ in items], [grams(terms(a)) for _, _, a in items], whole.longest,
        [text_grams(q, a) for _, q, a in items] if split else None,
    )


def retrieve(index: Index, words: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int, int, float]]:
    """(first word, end word, item, score) of every passage and item with a score of `threshold` or more.

    Passages are as long as two of the longest items at least, and each begins in the middle of the
    one before, so an item lies whole in one of them. Bounds are tried from loose to tight: the sum of
    all largest impacts (a running sum for all passages at once), the sum over distinct terms, the sums
    of block maxima; only blocks that can hold a hit are opened and scored.
    """
    get = index.words.get
    at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    place = np.flatnonzero(at >= 0)
    if not len(place):
        return []
    known = at[place]
    width = max(PASSAGE_WORDS, 2 * index.longest)
    starts = np.arange(0, max(1, len(words) - width // 2), width // 2)
    run = np.zeros(len(known) + 1)
    np.cumsum(index.most[known], out=run[1:])
    low, high = np.searchsorted(place, starts), np.searchsorted(place, starts + width)
    out = []
    for p in np.flatnonzero(run[high] - run[low] >= threshold - 1e-4):
        own = np.unique(known[low[p] : high[p]])
        if index.most[own].sum() < threshold - 1e-4:
            continue
        bounds = index.block_max[own].sum(0)
        for block in np.flatnonzero(bounds >= threshold - 1e-4):
            first = block * BLOCK_ITEMS
            scores = index.impact[own, first : first + BLOCK_ITEMS].sum(0, dtype=np.float64)
            for i in np.flatnonzero(scores >= threshold):
                out.append((int(starts[p]), int(starts[p] + width), first + int(i), float(scores[i])))
    return out


def leaks_in(index: Index, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
    """(item number, passages, first word, score, question overlap, answer overlap) of verified items."""
    words = terms(text)
    best: dict[int, list] = {}
    for start, end, item, score in retrieve(index, words, threshold):
        q, a = held(index.question[item], words[start:end]), held(index.answer[item], words[start:end])
        if (q >= overlap and a >= overlap) or (index.text and held(index.text[item], words[start:end]) >= overlap):
            found = best.setdefault(item, [0, start, score, q, a])
            found[0] += 1
            if score > found[2]:
                found[1:] = [start, score, q, a]
    return [(i, *best[i]) for i in sorted(best)]


def find_leaks(
    logs: DataFrame, items: DataFrame, job_id: str = "job_id", log: str = "log", item_id: str = "item_id",
    question: str = "question", answer: str = "answer", threshold: float = THRESHOLD, overlap: float = OVERLAP,
    split: bool = False,
) -> DataFrame:
    """Which logs hold which test items: a row for each log and item, with the best passage's figures.

    Every log is cut into overlapping passages; each is a query against the items' index. Items that
    score `threshold` of their own score or more are checked word by word: a passage must hold at least
    `overlap` of the three-word runs of the item's question and of its answer. With `split` the answers are not given
    but split off the items' texts: there `overlap` of the runs of question and answer as one text is a leak too.

    The index of at most CHUNK_ITEMS items goes to every task; more items are dealt by hash into chunks of
    half that size, each a pass over the logs, so what is sent out does not grow with the item table. Weights and
    passages come from all items, so a row does not depend on the chunk that its item is in. NULL and empty logs or items match
    nothing; repeated rows give a row each, repeated items one for each item row; other columns are not
    looked at. Nothing is shuffled.
    """
    rows = logs.select(F.col(job_id).cast("bigint").alias("job_id"), F.col(log).alias("log"))
    out = None
    for index in indexes(items.select(item_id, question, answer), split):
        found = rows.mapInArrow(_finder(index, threshold, overlap), LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def indexes(items: DataFrame, split: bool = False) -> Iterator[Index]:
    """Indexes over all items (id, question, answer), none of more than about CHUNK_ITEMS."""
    wanted = items.toDF("item_id", "question", "answer").withColumn("item_id", F.col("item_id").cast("bigint"))
    total = wanted.count()
    if total <= CHUNK_ITEMS:
        yield build_index([tuple(r) for r in wanted.collect() if terms(r[1]) or terms(r[2])], split=split)
        return
    chunks = -(-total // (CHUNK_ITEMS // 2))
    dealt = wanted.withColumn("chunk", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(chunks)).cast("int"))
    length = dealt.mapInArrow(_lengths, "length bigint").where("length > 0")
    n, words, longest = length.agg(F.count("length"), F.sum("length"), F.max("length")).first()
    counts = dealt.mapInArrow(_chunk_terms, "chunk int, term string").groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("df"))
    frequency = counts.groupBy("term").agg(F.collect_list("chunk").alias("chunks"), F.sum("df").alias("df"))
    frequency = written(frequency, shared_folder(items.sparkSession), "frequency")
    for chunk in range(chunks):
        mine = [tuple(r) for r in dealt.where(F.col("chunk") == chunk).drop("chunk").collect() if terms(r[1]) or terms(r[2])]
        own = frequency.where(F.array_contains("chunks", chunk)).select("term", "df").collect()
        yield build_index(mine, Whole(n, (words or 0) / max(1, n), longest or 0, {r.term: r.df for r in own}), split)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([len(terms(q)) + len(terms(a)) for q, a in texts], pa.int64())], names=["length"])


def _chunk_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk of each item and every distinct term of it."""
    for batch in batches:
        got = [(c, t) for _, q, a, c in zip(*[c.to_pylist() for c in batch.columns]) for t in {*terms(q), *terms(a)}]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in got], pa.int32()), pa.array([t for _, t in got], pa.string())], names=["chunk", "term"]
        )


def without_leaks(
    logs: DataFrame, items: DataFrame, log: str = "log", item_id: str = "item_id", question: str = "question",
    answer: str = "answer", threshold: float = THRESHOLD, overlap: float = OVERLAP, split: bool = False,
) -> DataFrame:
    """The rows of `logs` in which find_leaks has no item, as they are: all columns, repeated rows, NULL logs."""
    place, schema = logs.columns.index(log), logs.schema

    def cleaner(index: Index):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(place)
                yield batch.filter(pa.array([not leaks_in(index, t.as_py(), threshold, overlap) for t in texts], pa.bool_()))

        return clean

    for index in indexes(items.select(item_id, question, answer), split):
        if index.ids:
            logs = logs.mapInArrow(cleaner(index), schema)
    return logs


def _finder(index: Index, threshold: float, overlap: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            if index.ids:
                names = batch.column(0).to_pylist()
                for at, text in enumerate(batch.column(1)):
                    for item, n, first, score, q, a in leaks_in(index, text.as_py(), threshold, overlap):
                        got.append((names[at], index.ids[item], n, first, score, q, a))
            columns = list(zip(*got)) or [()] * len(ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

    return find
