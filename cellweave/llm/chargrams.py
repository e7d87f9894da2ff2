"""Characters of batches of texts as arrays: case, letters, scripts and hashed n-grams."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

CODES = 0x110000
#: First and last code point of the main blocks of each script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
N_SCRIPTS = len(SCRIPTS) + 1  # 0 is every other one
#: Multiplier of the gram hashes and the one that spreads them.
GRAM_BASE, GRAM_SPREAD = 0x100000001B3, 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, letter or not, part of a word or not, number of its script."""
    lower = np.arange(CODES, dtype=np.uint32)
    letter = np.zeros(CODES, bool)
    part = np.zeros(CODES, bool)
    for code in range(CODES):
        char = chr(code)
        if char.isalpha():
            letter[code] = part[code] = True
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
        elif code > 0x2FF and unicodedata.category(char)[0] == "M":
            part[code] = True
    script = np.zeros(CODES, np.int8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = number
    return lower, letter, part, script


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each followed by a line feed, and where each
    text begins (one entry more than texts)."""
    sizes = np.array([len(text) + 1 if text else 1 for text in texts], np.int64)
    joined = "\n".join([text or "" for text in texts]) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` codes from each place on (none for the last n - 1)."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    value = np.full(size, n, np.uint64)
    for i in range(n):
        value = value * np.uint64(GRAM_BASE) + codes[i : i + size]
    value ^= value >> np.uint64(29)
    value *= np.uint64(GRAM_SPREAD)
    return value
