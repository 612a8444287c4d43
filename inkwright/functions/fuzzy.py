"""Likeness of strings in plain Python, for Arrow functions; what is exact is asked first, and in the JVM."""

from __future__ import annotations

import difflib
import re

import pandas as pd

from inkwright.functions.arrow import arrow

_WORD = re.compile(r"[^\W_]+")


def words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def key(line: str) -> str:
    """Lower case, all but letters and digits one space."""
    return " ".join(_WORD.findall(line.casefold()))


def alike(a: str, b: str) -> float:
    """Twice the matching blocks over both lengths."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 and more characters of `a` a step (bit-parallel)."""
    if not a or not b:
        return 0
    mask = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    row = mask
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """1 less the insertions and deletions between them over both lengths; 1 of two empty strings."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, shorter windows at its ends.

    Windows end at the characters that the shorter one has; each is compared in whole, so this is
    for short queries. Containment is answered at once.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    n, seen, best = len(short), set(short), 0.0
    for end in range(1, len(long) + n):
        part = long[max(0, end - n) : end]
        if not part or (part[-1] not in seen if end <= len(long) else part[0] not in seen):
            continue
        best = max(best, ratio(short, part))
    return best


def near(pattern: str, text: str, k: int) -> list[int]:
    """Places in the text where a match within k edits ends (Sellers' columns, bit-parallel)."""
    m = len(pattern)
    if not m:
        return []
    at: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        at[ch] = at.get(ch, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    grow, fall, score, out = mask, 0, m, []
    for j, ch in enumerate(text, 1):
        eq = at.get(ch, 0)
        carry = (((eq & grow) + grow) ^ grow) | eq | fall
        up, down = fall | ~(carry | grow) & mask, grow & carry
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & mask, (down << 1) & mask
        grow, fall = (down | ~(carry | up)) & mask, up & carry
        if score <= k:
            out.append(j)
    return out


@arrow("double")
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x or "", y or "") for x, y in zip(a, b)])


@arrow("double")
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)])


@arrow("double")
def alike_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x or "", y or "") for x, y in zip(a, b)])
