"""Texts as arrays of letter symbols, for character n-grams that numpy can count."""

from __future__ import annotations

import unicodedata

import numpy as np

SYMBOLS = 64  # 0 is anything but a letter, 1-26 are a-z, 27-59 the letters from U+00DF to U+00FF, 60-63 all others


def _table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for c in range(0x80, 0x10000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = 60 + c % 4
    table[0xDF:0x100] = np.where(table[0xDF:0x100] > 0, np.arange(27, 60), 0)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


TABLE = _table()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def letter_symbols(text: str, codes: np.ndarray) -> np.ndarray:
    """One symbol per code point of a lower-cased text; letters beyond U+FFFF count as others."""
    if not len(codes) or codes.max() < 0x10000:
        return TABLE[codes]
    letters = np.fromiter((c.isalpha() for c in text), bool, len(codes))
    return np.where(codes < 0x10000, TABLE[np.minimum(codes, 0xFFFF)], np.where(letters, 60 + codes % 4, 0)).astype(np.uint8)


def symbols(text: str) -> np.ndarray:
    low = text.lower()
    return letter_symbols(low, code_points(low))


def ngrams(s: np.ndarray, n: int) -> np.ndarray:
    """Codes of all n-grams of symbols, 64 to the power of n of them."""
    if len(s) < n:
        return np.empty(0, np.int64)
    codes = np.zeros(len(s) - n + 1, np.int64)
    for i in range(n):
        codes = codes * SYMBOLS + s[i : len(s) - n + 1 + i]
    return codes


def once(codes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each code once; ``last`` is scratch space as long as there are codes."""
    at = np.arange(len(codes))
    last[codes] = at
    return codes[last[codes] == at]
