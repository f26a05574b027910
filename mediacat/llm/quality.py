"""Line-first cleaning of job logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
SYMBOL_TABLE = str.maketrans("", "", "#*$%&|<>")
ENDS = (".", "!", "?", ":", ";", ",", '"', "'", ")", "…", "»", "”")
NAVIGATION = frozenset(
    "home menu login logout register search contact about next previous back top skip share print sitemap help".split()
)
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie|click here|read more|sign up|subscribe"
    r"|javascript|lorem ipsum",
    re.I,
)
LEAST_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
LOST_PERCENT = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ARROW = [
    pa.field("job_id", pa.int64()), *[pa.field(c, pa.int64()) for c in COUNTS],
    pa.field("base_failed", pa.bool_()), pa.field("kept", pa.bool_()),
    pa.field("n_lines", pa.int64()), pa.field("n_bad_lines", pa.int64()),
    pa.field("lost_percent", pa.float64()), pa.field("cleaned", pa.string()),
]
SCHEMA = (
    "job_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, kept boolean, n_lines bigint, n_bad_lines bigint, lost_percent double, cleaned string"
)


def bad_line(line: str, words: list[str]) -> str | None:
    """Why a line fails, or None: 'punctuation', 'navigation' or 'boilerplate'.

    Punctuation: over a tenth of the line's letters are table or markup symbols, over a third of its
    words shout (three capitals or more and no small letter), or over half of its words end in an
    exclamation mark. Navigation: up to six words, half of them menu words, or a run of short cells
    between bars. Boilerplate: a stock phrase in a line of up to thirty words, or over a third of the
    words the same as the one before.
    """
    chars = sum(map(len, words))
    symbols = chars - sum(len(w.translate(SYMBOL_TABLE)) for w in words)
    if 10 * symbols > chars:
        return "punctuation"
    if len(words) >= 4:
        if 3 * sum(w.isupper() and len(w) > 2 for w in words) > len(words):
            return "punctuation"
        if 2 * sum(w.endswith("!") for w in words) > len(words):
            return "punctuation"
    bare = [w.strip(".,:;|>").lower() for w in words] if len(words) <= 6 or "|" in line else []
    if len(bare) <= 6 and bare and 2 * sum(b in NAVIGATION for b in bare) >= len(bare):
        return "navigation"
    if 3 * words.count("|") >= len(words):
        return "navigation"
    if len(words) <= 30 and BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) >= 4 and 3 * sum(a == b for a, b in zip(words, words[1:])) > len(words):
        return "boilerplate"
    return None


def _repeated_words(texts: list[str]) -> np.ndarray:
    """Per text, the words in windows of five that occur twice or more in it, the first included."""
    w = Words(texts)
    at, prints = w.windows(w.hashes(), REPEAT_WINDOW)
    if not len(at):
        return np.zeros(len(texts), np.int64)
    owner = w.text[at]
    order = np.lexsort((prints, owner))
    same = (prints[order][1:] == prints[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    hit = np.zeros(len(w.text) + 1, np.int32)
    np.add.at(hit, at[twice], 1)
    np.add.at(hit, at[twice] + REPEAT_WINDOW, -1)
    return np.bincount(w.text[np.cumsum(hit[:-1]) > 0], minlength=len(texts))


def _judge(text: str, repeats: int) -> tuple:
    lines, seen, dup, kept_lines = text.split("\n"), set(), 0, []
    n_words = word_chars = good_chars = n_lines = bad = 0
    for line in lines:
        words = WORD.findall(line)
        if not words:
            continue
        n_lines += 1
        chars = sum(map(len, words))
        n_words += len(words)
        word_chars += chars
        again = line in seen
        seen.add(line)
        dup += again
        if again or bad_line(line, words):
            bad += 1
        else:
            good_chars += chars
            kept_lines.append(line)
    failed = n_words < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * n_words
    lost = 100.0 * (word_chars - good_chars) / word_chars if word_chars else 100.0
    return (
        n_words, word_chars, len(SYMBOLS.findall(text)), dup, repeats, failed,
        not failed and lost <= LOST_PERCENT, n_lines, bad, lost, "\n".join(kept_lines),
    )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = [t or "" for t in part.column(1).to_pylist()]
            repeats = _repeated_words(texts).tolist()
            columns = zip(*[_judge(t, r) for t, r in zip(texts, repeats)])
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, ARROW[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], schema=pa.schema(ARROW))


def clean_logs(logs: DataFrame, job_id: str = "job_id", log: str = "log") -> DataFrame:
    """Job logs line by line: failing and repeated lines go, then logs that lose over half of their text.

    Words are runs of bytes other than space and 9 to 13. A line without words is ignored. Base
    figures: word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to an
    earlier one), n_repeat_words (words in five-word windows that occur twice or more in the log).
    base_failed: fewer than ten words, or over a fifth of them repeated. `lost_percent` is the share of
    word characters in failed lines; a log is kept when it does not fail the base and loses at most
    half. `cleaned` is what is left of it.

    One row in, one row out, in any order: NULL counts as empty (base_failed, 100 % lost), repeated
    rows are judged each, other columns are not looked at. Each log is judged on its own, so nothing is
    shuffled.
    """
    return logs.select(F.col(job_id).cast("bigint").alias("job_id"), F.col(log).alias("log")).mapInArrow(_cleaned, SCHEMA)
