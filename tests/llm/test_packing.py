"""Token pieces against the tokenizer itself, and packing against its own rules."""

import random
import zlib

import numpy as np
import pytest

from mediacat.llm import packing as P
from mediacat.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokens():
    return P.Tokens(tokenizer_file())


def test_ids_are_the_tokenizers(tokens):
    rng = random.Random(5)
    signs = "aAbzéÉİıßŉǅ_'sStTrRve0159²½ªº.,!?-|<>\\ \t\n\r\x0b\x0c\x85\xa0\x1c\x00«»“”…—" + "Σσς́あя中​"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", "it's I'LL we'Ve", "<|endoftext|> x", "a" * 5000, "ΟΔΟΣ ΣΑΣ"]
    texts += ["".join(chr(c) for c in range(0x250)), " ".join(chr(c) for c in range(0x250))]
    want = tokens.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, got, e in zip(texts, tokens.encode(texts), want):
        assert got.tolist() == [*e.ids, 1], repr(text)


def test_runs_need_the_model_only(tokens):
    """Runs go past the normalizer and the split, with the ids that the whole tokenizer gives; listed classes split as categories do."""
    assert tokens.of_runs.normalizer is None
    by_category = P.re.compile(r"[^\W\d_²³¹¼½¾]+|'(?:s|t|re|ve|m|ll|d)|[\d²³¹¼½¾]|(?:[^\w\s]+|_+)+")
    rng = random.Random(9)
    texts = [p.lower() for p in P.PLAIN] + ["".join(rng.choice(P.PLAIN + list("'strevmld__ ") * 9) for _ in range(60)).lower() for _ in range(2000)]
    for text in texts:
        assert P.RUNS.findall(text) == by_category.findall(text), repr(text)
    runs = sorted({r for text in texts for r in P.RUNS.findall(text)})
    got, want = [t.encode(runs, is_pretokenized=True, add_special_tokens=False) for t in (tokens.of_runs, tokens.tokenizer)]
    assert len(runs) > 5000 and got.ids == want.ids and got.word_ids == want.word_ids


def test_forgetting_changes_nothing(tokens, monkeypatch):
    monkeypatch.setattr(P, "CACHED_RUNS", 50)
    monkeypatch.setattr(P, "KEPT_RUNS", 20)
    own = P.Tokens(tokenizer_file())
    for n in range(30):
        text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + (i + n) % 26)}" for i in range(40))
        assert own.encode([text])[0].tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_best_fit_fills_the_tightest_bin():
    assert P.best_fit([5, 4, 3, 3, 2, 2, 1], 10) == [[0, 1, 6], [2, 3, 4, 5]]
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(500)]
    bins = P.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert sum(sum(sizes[i] for i in b) <= 50 for b in bins) <= 1  # two such would have been one


def test_pack_logs(spark, monkeypatch):
    monkeypatch.setattr(P, "NODE_ITEMS", 40)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["frame", "error", "hevc"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "x " * 200), (7, "again"), (None, "no job")]
    logs = spark.createDataFrame([(j, t, "clash", 1) for j, t in rows], "job_id bigint, log string, length string, piece int")
    got = P.pack_pieces(P.token_pieces(logs, tokenizer_file(), length=64), 64).collect()
    by_sequence, by_piece = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_piece.setdefault(r.job_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) <= 64
    assert set(by_piece) == {j for j, _ in rows} and len(by_piece[7]) == 2
    assert [(r.length, r.ids_crc32) for r in by_piece[300]] == [(1, zlib.crc32(b"\1\0\0\0"))] * 1
    long = sorted(by_piece[302], key=lambda r: r.piece)
    assert [r.length for r in long[:-1]] == [64] * (len(long) - 1) and [r.start for r in long] == [64 * i for i in range(len(long))]
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 64) + 4
    empty = P.pack_pieces(P.token_pieces(logs.limit(0), tokenizer_file()))
    assert empty.count() == 0


def test_bins_of_all_nodes_up_to_half_full_meet(spark, monkeypatch):
    """Hardly anything fits together in a round, and still the few small pieces of different nodes share sequences."""
    monkeypatch.setattr(P, "NODE_ITEMS", 40)
    sizes = [60] * 400 + [45] * 12
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], P.PIECES)
    got = P.pack_pieces(pieces, 100).collect()
    assert len(got) == 412 and len({r.sequence_id for r in got}) == 406
