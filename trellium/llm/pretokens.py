"""Splitting of texts by the pattern of the public byte-level vocabularies, on arrays.

The pattern:  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each code point has one of four classes; a pretoken is a run of one class with rules at its start:
a single space before a run of letters, numbers or others belongs to it; of several white-space
characters before something else the last stands apart (or joins as that space); contractions are
cut off letters after a lone apostrophe.  `split` does all of this with a few array passes.
"""

from __future__ import annotations

import sys

import numpy as np

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
_TABLE: np.ndarray | None = None
#: What the regular expression engine counts as white space (\\s).
_WHITE = [*range(9, 14), *range(28, 32), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        import regex

        t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        patterns = [(kind, regex.compile(p)) for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"))]
        for first in range(0, sys.maxunicode + 1, 1 << 11):  # in parts, so that a worker's memory stays small; surrogates are none
            if 0xD800 <= first < 0xE000:
                continue
            part = "".join(map(chr, range(first, first + (1 << 11))))
            for kind, p in patterns:
                for m in p.finditer(part):
                    t[first + m.start() : first + m.end()] = kind
        _TABLE = t
    return _TABLE


def split(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pretokens of some texts; points: the code points of all, offsets: where each text starts and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    cut |= head[:-1]
    # the last white-space character before something else, inside one text
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:-1]
    cut |= last
    joins = last & (points == 32)
    at = np.flatnonzero(joins) + 1
    cut[at] = False
    # contractions: a lone apostrophe that opens a pretoken, then letters
    quote = np.flatnonzero(points == 39)
    if len(quote):
        quote = quote[cut[quote]]
        end = offsets[np.searchsorted(offsets, quote, "right")]
        c1 = np.where(quote + 1 < end, points[np.minimum(quote + 1, n - 1)], 0)
        c2 = np.where(quote + 2 < end, points[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for size, hit in ((1, one), (2, two)):
            q = quote[hit]
            cut[q + 1] = False
            rest = q + 1 + size
            stop = end[hit]
            rest = rest[(rest < stop)]
            cut[rest] |= kind[rest] == LETTER
    return np.flatnonzero(cut)


