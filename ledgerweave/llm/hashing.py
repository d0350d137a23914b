"""64-bit hashes of words and word shingles, for whole texts at a time."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15 | 3)


class Words:
    """Polynomial 64-bit hashes of all words of a text at once; powers grow with the longest word."""

    def __init__(self) -> None:
        self.powers = np.ones(64, np.uint64)
        self._fill(1)

    def _fill(self, start: int) -> None:
        with np.errstate(over="ignore"):
            for i in range(start, len(self.powers)):
                self.powers[i] = self.powers[i - 1] * STEP

    def hashes(self, tokens: list[bytes]) -> np.ndarray:
        if not tokens:
            return np.zeros(0, np.int64)
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if (longest := int(length.max())) > len(self.powers):
            old, self.powers = len(self.powers), np.resize(self.powers, longest)
            self._fill(old)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        within = np.arange(len(data)) - np.repeat(start, length)
        with np.errstate(over="ignore"):
            h = np.add.reduceat(BYTE_HASH[data] * self.powers[within], start) + length.astype(np.uint64)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def tokens(text: str | None) -> list[bytes]:
    """Runs of non-space characters with A-Z in lower case; null has none."""
    return (text or "").encode().lower().split()


MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(hashes: np.ndarray, k: int = 4) -> np.ndarray:
    """Distinct hashes of all runs of ``k`` words; of the whole sequence if it is shorter."""
    h = hashes.view(np.uint64)
    if not len(h):
        return h
    width = min(k, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            s = (s ^ (s >> np.uint64(31))) * MIX[j % len(MIX)] + h[j : len(h) - width + 1 + j]
        s ^= s >> np.uint64(32)
        s *= np.uint64(0xC4CEB9FE1A85EC53)
        s ^= s >> np.uint64(29)
    return np.unique(s)
