"""Toxicity of job logs by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.words import TERMS, Words, spans

BITS = 18
FACTORS = 4
SAMPLE_ROWS = 20_000
EPOCHS = 8
RATE = 0.1
DECAY = 2e-5
LEAST_CHI2 = 20.0
COMMON_SHARE = 0.02
STEM_BYTES = (4, 5)
SEED = 11


@dataclass(frozen=True)
class Machine:
    """bias + sum of w over a log's terms + sum over pairs of terms of the product of their factors."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, terms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log odds; terms of all logs in a row, and how many each log has."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        out = self.bias + np.bincount(owner, self.w[terms], len(lengths))
        for k in range(self.v.shape[1]):
            f = self.v[terms, k].astype(np.float64)
            out += (np.bincount(owner, f, len(lengths)) ** 2 - np.bincount(owner, f * f, len(lengths))) / 2
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*hashed_terms(texts, self.w != 0)), -30, 30)))


def hashed_terms(texts: list[str | None], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text in a row, and their number per text.

    A term is a run of letters, digits and non-ASCII characters, in lower case, or the first four or
    five bytes of a longer one, which inflected forms share. known: the slots to look at, all by default.
    """
    w = Words(texts, TERMS)
    values, long = w.letters.astype(np.uint64) + np.uint64(1), w.ends - w.starts
    slots, owners = [spans(values, w.starts, w.ends, 0)], [w.text]
    for n in STEM_BYTES:
        at = w.starts[long > n]
        slots.append(spans(values, at, at + n, 2))
        owners.append(w.text[long > n])
    slot = (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int64)
    both = (np.concatenate(owners) << BITS) | slot
    both = np.unique(both if known is None else both[known[slot]])
    return both & ((1 << BITS) - 1), np.bincount(both >> BITS, minlength=len(texts))


def informative(terms: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
    seen = np.bincount(flat, minlength=1 << BITS).astype(np.float64)
    with_label = np.bincount(flat, np.repeat(toxic, [len(t) for t in terms]), minlength=1 << BITS)
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    expected = seen * share
    chi2 = (with_label - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9)
    common = seen >= max(2, COMMON_SHARE * len(terms))
    return (seen >= 3) & ((chi2 >= LEAST_CHI2) | common)


def train(terms: list[np.ndarray], toxic: np.ndarray, epochs: int = EPOCHS) -> Machine:
    """Logistic loss, Adagrad, small batches; each log's terms count once.

    A term takes part when its logs are toxic more or less often than chance allows (chi-squared), or
    when it is common enough to be the other half of a pair; all others keep weight zero.
    """
    rng = np.random.default_rng(SEED)
    used = informative(terms, toxic)
    terms = [t[used[t]] for t in terms]
    w = np.zeros(1 << BITS)
    v = np.where(used[:, None], rng.normal(0, 0.01, (1 << BITS, FACTORS)), 0)
    gw, gv = np.full(1 << BITS, 1e-2), np.full((1 << BITS, FACTORS), 1e-2)
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    bias = float(np.log(share / (1 - share)))
    for _ in range(epochs):
        order = rng.permutation(len(terms))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            flat = np.concatenate([terms[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(terms[r]) for r in rows])
            ids, place = np.unique(flat, return_inverse=True)
            x = np.zeros((len(rows), len(ids)))
            x[owner, place] = 1
            sums = x @ v[ids]
            raw = bias + x @ w[ids] + ((sums**2) - x @ (v[ids] ** 2)).sum(1) / 2
            off = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic[rows]
            bias -= RATE * 0.1 * off.mean()
            dw = off @ x + DECAY * len(rows) * 50 * w[ids]
            dv = x.T @ (off[:, None] * sums) - (off @ x)[:, None] * v[ids] + DECAY * len(rows) * 50 * v[ids]
            gw[ids] += dw**2
            gv[ids] += dv**2
            w[ids] -= RATE * dw / np.sqrt(gw[ids])
            v[ids] -= RATE * dv / np.sqrt(gv[ids])
    return Machine(bias, w.astype(np.float32), v.astype(np.float32))


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, lengths = hashed_terms(batch.column(0).to_pylist())
        parts = np.split(terms.astype(np.int32), np.cumsum(lengths)[:-1]) if len(lengths) else []
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([p.tobytes() for p in parts], pa.binary())], names=["toxic", "terms"]
        )


def _trained(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["toxic", "terms"], kind="stable")  # the same model whatever order rows came in
    m = train([np.frombuffer(t, np.int32).astype(np.int64) for t in rows["terms"]], rows["toxic"].to_numpy(np.float64))
    return pd.DataFrame({"bias": [m.bias], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})


def learn_machine(
    logs: DataFrame, labels: DataFrame, job_id: str = "job_id", log: str = "log", toxic: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Machine:
    """Fit on at most `sample_rows` labelled logs: those whose job ids hash lowest.

    Labels other than 0 and 1 and labels without a log are passed over. Without any usable row the
    machine calls nothing toxic.
    """
    chosen = (
        labels.select(F.col(job_id).alias("job_id"), F.col(toxic).cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("job_id").isNotNull())
        .orderBy(F.xxhash64("job_id"), "job_id", "toxic").limit(sample_rows)
    )
    texts = logs.select(F.col(job_id).alias("job_id"), F.col(log).alias("log")).join(chosen, "job_id")
    got = (
        texts.select("log", "toxic").mapInArrow(_term_lists, "toxic int, terms binary")
        .groupBy(F.lit(0).alias("all")).applyInPandas(_trained, "bias double, w binary, v binary").first()
    )
    if got is None:
        return Machine(-1.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32))
    return Machine(got["bias"], np.frombuffer(got["w"], np.float32), np.frombuffer(got["v"], np.float32).reshape(-1, FACTORS))


def score_logs(logs: DataFrame, machine: Machine, job_id: str = "job_id", log: str = "log") -> DataFrame:
    """Every log's probability of being toxic: job_id, score (0 to 1), predicted (1 from 0.5 on).

    Insults gain or lose by what stands with them: pairs of terms have weights of their own, through
    their factors, which a sum of single weights cannot have. The machine has a fixed size (2**18 terms)
    and goes to every task. NULL and empty logs get the score of no terms; each row is scored on its own,
    repeated rows alike; other columns are not looked at.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                score = machine.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["job_id", "score", "predicted"],
                )

    rows = logs.select(F.col(job_id).cast("bigint").alias("job_id"), F.col(log).alias("log"))
    return rows.mapInArrow(scored, "job_id bigint, score double, predicted int")


def without_toxic(logs: DataFrame, machine: Machine, log: str = "log") -> DataFrame:
    """The rows of `logs` whose score is below 0.5, as they are: all columns, repeated rows, NULL logs."""
    place = logs.columns.index(log)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(machine.score(part.column(place).to_pylist()) < 0.5))

    return logs.mapInArrow(clean, logs.schema)
