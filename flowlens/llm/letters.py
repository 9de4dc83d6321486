"""Code points of texts as numpy arrays, lower-cased, with other characters marked."""

from __future__ import annotations

from functools import cache

import numpy as np

TOP = 0x110000


@cache
def lower_table(digits: bool) -> np.ndarray:
    """Code point -> lower-case code point of a letter (or digit), 0 for anything else."""
    out = np.zeros(TOP, np.uint32)
    for cp in range(TOP):
        ch = chr(cp)
        if ch.isalpha() or digits and ch.isdecimal():
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the length of each text."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def lowered(texts: list[str], digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """``code_points`` through ``lower_table``."""
    cp, lengths = code_points(texts)
    return lower_table(digits)[cp], lengths


def rolling(values: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of every run of q values (polynomial, by doubling); one per start, len - q + 1 of them."""
    base = 0x9E3779B97F4A7C15
    have, h = 1, (values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    out, out_len = None, 0
    left = q
    while left:
        if left & 1:
            if out is None:
                out, out_len = h, have
            else:
                n = len(values) - (out_len + have) + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] * np.uint64(pow(base, have, 1 << 64)) + h[out_len:out_len + n]
                out_len += have
        left >>= 1
        if left:
            n = len(values) - 2 * have + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            h = h[:n] * np.uint64(pow(base, have, 1 << 64)) + h[have:have + n]
            have *= 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))
