"""Words, windows and their fingerprints over a batch of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

U = np.uint64
_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93, 2: 0xC2B2AE3D27D4EB4F, 3: 0xA0761D6478BD642F}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    powers = np.full(n, base, U)
    powers[:1] = 1
    return np.cumprod(powers)


#: The powers below STEP of each lane's base and of its inverse; all others are a product with one of every STEP-th.
STEP = 1024
_LOW = {lane: (_powers(b | 1, STEP), _powers(pow(b | 1, -1, 2**64), STEP)) for lane, b in _BASE.items()}


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Fingerprint of values[start:end] for each start and end; the same wherever the run stands.

    Nothing of the size of `values` is kept from call to call.
    """
    base, (up, down), steps = _BASE[lane] | 1, _LOW[lane], len(values) // STEP + 1
    sums = np.zeros(len(values) + 1, U)
    every = _powers(pow(base, STEP, 2**64), steps)
    np.cumsum(values * (every[:, None] * up).ravel()[: len(values)], out=sums[1:])
    back = _powers(pow(base, -STEP, 2**64), steps)[starts // STEP] * down[starts % STEP]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(U))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and every ASCII sign a space.
TERMS = LOWER.copy()
TERMS[[i for i in range(128) if not chr(i).isalnum()]] = 32


class Words:
    """The words of a batch of texts: runs of bytes other than space and bytes 9 to 13.

    data: the UTF-8 bytes of all texts, a line feed after each; letters: the same through `table`, which
    may change bytes before words are taken. starts, ends: each word's place in
    data. text: the number of its text. first: the number of each text's first word, and the total.
    """

    def __init__(self, texts: Iterable[str | bytes | None], table: np.ndarray | None = None):
        parts = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        if table is not None:
            raw = table[raw]
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
        self.offsets = offsets
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(parts)), self.counts)
        self.letters = raw

    def hashes(self, lane: int = 0) -> np.ndarray:
        return spans(self.letters.astype(U) + U(1), self.starts, self.ends, lane)

    def windows(self, hashes: np.ndarray, width: int, lane: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first words and fingerprints of all windows of `width` words of one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        return at, spans(hashes, at, at + width, lane)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in [start, start + width) of any start."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0
