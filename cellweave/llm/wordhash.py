"""Hashes of words and of runs of words, for whole batches of texts at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Odd multipliers of the two rolling hashes and the finalizer.
BYTE_BASE, WORD_BASE, MIX_1, MIX_2 = (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(MIX_1)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(MIX_2)
    return values ^ (values >> np.uint64(31))


@cache
def power_tables(base: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses; as long as was needed so far."""
    return [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    tables = power_tables(base)
    if len(tables[0]) < size:
        length = 1 << max(16, (size - 1).bit_length())
        for row, factor in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(length, factor, np.uint64)
            steps[0] = 1
            tables[row] = np.cumprod(steps, dtype=np.uint64)
    return tables[0], tables[1]


def rolling(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers from which the hash of any run follows in one step."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def run_hashes(
    sums: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray
) -> np.ndarray:
    return mixed((sums[end] - sums[begin]) * down[begin])


@dataclass
class Words:
    """The words of several texts in one row: where each begins and ends in the bytes, where
    each text begins among the words, and the rolling hash over the words."""

    starts: np.ndarray
    ends: np.ndarray
    text_at: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    def grams(self, begin: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` words from each of ``begin`` on."""
        return run_hashes(self.sums, self.down, begin, begin + n)


def words_of(texts: list[str | bytes | None]) -> Words:
    """Cut texts into words at ASCII white space and hash them."""
    encoded = [text if isinstance(text, bytes) else (text or "").encode() for text in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    lengths = np.array([len(part) + 1 for part in encoded], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = (data != 32) & ((data < 9) | (data > 13))
    change = np.diff(inside)
    starts = np.flatnonzero(change == 1)
    ends = np.flatnonzero(change == -1)
    sums, down = rolling(data.astype(np.uint64) + np.uint64(1), BYTE_BASE)
    hashes = run_hashes(sums, down, starts, ends)
    sums, down = rolling(hashes, WORD_BASE)
    return Words(starts, ends, np.searchsorted(starts, begins), sums, down)
