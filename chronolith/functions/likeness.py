"""Likeness of texts by longest matching blocks, for many pairs at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: In a second text of so many characters, one that makes up over a hundredth of it begins no block; fixed values.
LONG, SHARE = 200, 100
#: Cells of the tables of pairs, a character of the one by one of the other, that one batch has.
CELLS = 1 << 22


def plain(text: str | None) -> str:
    """As texts are compared: trimmed, in lower case."""
    return (text or "").strip().lower()


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters in one array, where each text begins, and lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum(sizes) - sizes, sizes


def _usual(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which characters may begin a block: all but those that a long text has too often."""
    ok = np.ones(len(codes), bool)
    for at, n in zip(starts[sizes >= LONG], sizes[sizes >= LONG], strict=True):
        _, where, often = np.unique(codes[at : at + n], return_inverse=True, return_counts=True)
        ok[at : at + n] = often[where] <= n // SHARE + 1
    return ok


def _each(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair and the offset of every character of the texts that begin at ``starts``."""
    pair = np.repeat(np.arange(len(sizes)), sizes)
    return pair, np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(a, b, ok, sa, la, sb, lb):
    """(pair, offset in a, offset in b, length) of the runs of equal characters that may begin a block, by pair."""
    pa, ia = _each(sa, la)
    pb, jb = _each(sb, lb)
    begins = ok[sb[pb] + jb]
    pb, jb = pb[begins], jb[begins]
    there = pb << 32 | b[sb[pb] + jb]
    order = np.argsort(there, kind="stable")
    there, jb = there[order], jb[order]
    here = pa << 32 | a[sa[pa] + ia]
    low = np.searchsorted(there, here, "left")
    n = np.searchsorted(there, here, "right") - low
    j = jb[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    # In the order of pair, diagonal and place, cells of a run follow one another without a gap.
    wide, deep = int(la.max()) + 1, int(la.max() + lb.max()) + 1
    i = np.repeat(ia, n)
    cells = (np.repeat(pa, n) * deep + i - j + lb.max()) * wide + i
    cells.sort()
    first = np.flatnonzero(np.diff(cells, prepend=-2) != 1)
    size = np.diff(np.append(first, len(cells)))
    i, rest = cells[first] % wide, cells[first] // wide
    return rest // deep, i, i - (rest % deep - lb.max()), size


def _grown(a, b, sa, sb, i, j, size, box):
    """Blocks with equal characters before and after them, inside their boxes."""
    a0, a1, b0, b1 = box
    while True:
        back = (i > a0) & (j > b0)
        back[back] = a[(sa + i - 1)[back]] == b[(sb + j - 1)[back]]
        if not back.any():
            break
        i, j, size = i - back, j - back, size + back
    while True:
        on = (i + size < a1) & (j + size < b1)
        on[on] = a[(sa + i + size)[on]] == b[(sb + j + size)[on]]
        if not on.any():
            return i, j, size
        size = size + on


def _common(a, b, ok, sa, la, sb, lb) -> np.ndarray:
    """Characters in matching blocks of each pair.

    The longest block of a box, of equals the first in a and then in b, grows by equal characters and splits what is left
    into a box before and one after it. All open boxes of all pairs make a round together; runs are cut to their new boxes.
    """
    common, pair, none = np.zeros(len(sa), np.int64), np.arange(len(sa)), np.zeros(len(sa), np.int64)
    box, own = np.stack([none, la, none, lb]), pair
    at, i, j, size = _runs(a, b, ok, sa, la, sb, lb)
    wide = int(max(la.max(), lb.max())) + 1
    while len(own):
        # Where nothing may begin a block, equal characters at the corner of the box make one.
        bi, bj, bn = box[0].copy(), box[2].copy(), np.zeros(len(own), np.int64)
        if len(at):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            best = np.minimum.reduceat(((wide - size) * wide + i) * wide + j, first)
            bi[at[first]], bj[at[first]], bn[at[first]] = best // wide % wide, best % wide, wide - best // wide**2
        bi, bj, bn = _grown(a, b, sa[own], sb[own], bi, bj, bn, box)
        np.add.at(common, own, bn)
        sides = [np.stack([box[0], bi, box[2], bj]), np.stack([bi + bn, box[1], bj + bn, box[3]])]
        open_ = [(bn > 0) & (s[0] < s[1]) & (s[2] < s[3]) for s in sides]
        runs, before = [], 0
        for s, o in zip(sides, open_, strict=True):
            name = np.where(o, np.cumsum(o) - 1 + before, -1)
            before += int(o.sum())
            d = i - j
            low, high = np.maximum(np.maximum(i, s[0][at]), s[2][at] + d), np.minimum(np.minimum(i + size, s[1][at]), s[3][at] + d)
            kept = (name[at] >= 0) & (low < high)
            runs.append(np.stack([name[at], low, low - d, high - low])[:, kept])
        box = np.concatenate([s[:, o] for s, o in zip(sides, open_, strict=True)], axis=1)
        own = np.concatenate([own[o] for o in open_])
        at, i, j, size = np.concatenate(runs, axis=1)
    return common


def ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """For each pair of plain texts twice the characters in matching blocks, of those of both; 0 where one is empty.

    Pairs go in batches of about ``CELLS`` cells of their tables, or alone. The memory of a batch is that of its cells with
    equal characters, of which a long text leaves those of its rarer ones.
    """
    a, at_a, la = _flat(xs)
    b, at_b, lb = _flat(ys)
    out = np.zeros(len(xs))
    some = np.flatnonzero((la > 0) & (lb > 0))
    if len(some) == 0:
        return out
    ok = _usual(b, at_b, lb)
    batch = np.cumsum(la[some] * lb[some]) // CELLS
    for own in np.split(some, np.flatnonzero(np.diff(batch)) + 1):
        common = _common(a, b, ok, at_a[own], la[own], at_b[own], lb[own])
        out[own] = 2.0 * common / (la[own] + lb[own])
    return out


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two strings in common by longest matching blocks, trimmed and in lower case; 0 if either is empty."""
    return pd.Series(ratios([plain(x) for x in a], [plain(y) for y in b]), dtype="float64")
