"""Pieces of text before subword encoding, found on arrays of code points.

The two published splitting patterns are run over a whole batch of texts at once: class
of every code point, runs of equal class, then the few exceptions (contractions, the
space in front of a run, single digits). The classes follow the Unicode tables of the
interpreter; white space is the Unicode property of that name.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER, BREAK = 0, 1, 2, 3, 4
#: Stands between texts; a lone surrogate never occurs in a valid string.
BETWEEN = "\ud800"
#: The same between texts of ASCII only, which take one byte a character.
ASCII_BETWEEN = "\x80"
#: White space of the Unicode standard, and the contractions of the pattern.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    table[ord(BETWEEN)] = BREAK
    return table


@cache
def ascii_classes() -> np.ndarray:
    table = classes()[:256].copy()
    table[ord(ASCII_BETWEEN)] = BREAK
    return table


def split(texts: list[str], *, keep_space: bool) -> tuple[list[str], np.ndarray]:
    """All pieces of all texts in order, and the number of pieces of each text.

    ``keep_space``: a run takes the blank in front of it, other white space makes pieces
    of its own (byte-level pattern). Otherwise white space is dropped and every digit
    stands alone (word pattern).
    """
    if all(map(str.isascii, texts)):
        joined = ASCII_BETWEEN.join([*texts, ""])
        code = np.frombuffer(joined.encode("latin-1"), np.uint8)
        kind = ascii_classes()[code]
    else:
        joined = BETWEEN.join([*texts, ""])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[code]
    n = len(code)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= kind == BREAK
    if not keep_space:
        first |= kind == NUMBER
    # A contraction: an apostrophe alone in its run, where a piece may start, and the letters behind it.
    marks = np.flatnonzero((code == 0x27) & first)
    marks = marks[marks + 1 < n]
    marks = marks[kind[marks + 1] == LETTER]
    if keep_space:
        marks = marks[(marks == 0) | (code[marks - 1] != 0x20)]
    for p in marks.tolist():
        for tail in SHORT:
            if joined.startswith(tail, p + 1):
                first[p + 1] = False
                if p + 1 + len(tail) < n:
                    first[p + 1 + len(tail)] = True
                break
    if keep_space:
        # The last blank of a run of white space belongs to what follows, if something follows in the text.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
        first[last] = True
        first[last[code[last] == 0x20] + 1] = False
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    what = kind[starts]
    stops = np.flatnonzero(what == BREAK)
    counts = np.diff(stops, prepend=-1) - 1
    keep = what != BREAK
    if not keep_space:
        keep &= what != SPACE
        counts = np.diff(np.concatenate([[0], np.cumsum(keep)[stops]]))
    return [joined[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())], counts
