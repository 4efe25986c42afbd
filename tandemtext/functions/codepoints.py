"""Vectorised work on batches of texts as arrays of code points."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

from tandemtext.functions.folding import TAG, fold

MASK53 = np.uint64((1 << 53) - 1)


@functools.cache
def fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether folding keeps it, and its lower case."""
    import regex

    every = "".join(map(chr, range(sys.maxunicode + 1)))
    keep = np.ones(sys.maxunicode + 1, bool)
    keep[[m.start() for m in regex.finditer(r"[\p{White_Space}\p{P}]", every)]] = False
    low = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for o in range(sys.maxunicode + 1):
        if unicodedata.category(every[o]) in ("Lu", "Lt", "So", "Nl") and len(x := every[o].lower()) == 1:
            low[o] = ord(x)
    return keep, low


def codepoints(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and where each text starts (one more offset than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def slices(texts: Sequence[str | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Parts of a batch with at most so many code points, or one text: bounds memory where texts are long."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def fold_batch(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The folded texts (no tag markers, white space, punctuation; lower case) as code points with offsets; null counts as empty.

    Equal to fold() of each text: the two letters whose lower case is not one letter everywhere are left to it.
    """
    keep, low = fold_tables()
    clean = ["" if t is None else fold(t) if "Σ" in t or "İ" in t else TAG.sub("", t) if "<tag" in t else t for t in texts]
    points, offsets = codepoints(clean)
    mask = keep[points]
    kept = np.zeros(len(points) + 1, np.int64)
    np.cumsum(mask, out=kept[1:])
    return low[points[mask]], kept[offsets]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between offsets, wrapping around in their type; 0 for empty segments."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def trigrams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three code points inside each text, packed into 63 bits without loss, and the text each belongs to."""
    if len(points) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = points.astype(np.uint64)
    grams = (p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    return grams[inside], owner[:-2][inside]
