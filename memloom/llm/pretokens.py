"""Splitting of texts into the pieces that a BPE vocabulary works on, over code-point arrays.

Both rules are finite-state: where a piece begins depends on the classes (letter,
number, blank, other) of a code point and its neighbours, so they are evaluated for
a whole slice at once.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

BLANK, LETTER, NUMBER, OTHER = range(4)
#: The suffixes that both vocabularies split off after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            table[point] = LETTER if kind == "L" else NUMBER
        elif chr(point).isspace() and not 0x1C <= point <= 0x1F:
            table[point] = BLANK
    return table


def _changes(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a run of one class begins (rows begin runs)."""
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[offsets < len(kind)]] = True
    return new


def _split_suffixes(points: np.ndarray, kind: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> None:
    """Move the piece starts around 's, 't, 're and the like, where the apostrophe begins a piece."""
    n = len(points)
    quotes = np.flatnonzero(start & (points == 39))
    if not len(quotes):
        return
    room = np.repeat(offsets[1:], np.diff(offsets))[quotes] - quotes
    padded = np.concatenate([points, np.zeros(3, np.uint32)])
    done = np.zeros(len(quotes), bool)
    for suffix in SUFFIXES:
        fits = ~done & (room > len(suffix))
        for j, c in enumerate(suffix, 1):
            fits &= padded[quotes + j] == ord(c)
        at = quotes[fits]
        start[at + 1] = False
        after = at + 1 + len(suffix)
        inside = after[after < n]
        start[inside[kind[inside] != BLANK]] = True
        done |= fits


def spaced_pieces(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-level rule: a piece may begin with one space; blanks before it are a piece of their own."""
    n = len(points)
    kind = classes()[points]
    new = _changes(kind, offsets)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = new.copy()
    blank = kind == BLANK
    glued = np.zeros(n, bool)
    glued[1:] = (points[:-1] == 32) & ~blank[1:] & ~edge[1:-1]
    start &= ~glued
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:-1]
    start |= last
    _split_suffixes(points, kind, offsets, start)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def word_pieces(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word rule: letter runs, single numbers and runs of others; blanks only separate."""
    n = len(points)
    kind = classes()[points]
    start = _changes(kind, offsets) | (kind == NUMBER)
    _split_suffixes(points, kind, offsets, start)
    bounds = np.flatnonzero(start)
    ends = np.append(bounds[1:], n)
    real = kind[bounds] != BLANK
    return bounds[real], ends[real]
