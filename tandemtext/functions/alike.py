"""Numpy kernel that finds the similar ones among many queries and one block of texts, without a limit on their number."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tandemtext.functions.codepoints import mix64
from tandemtext.functions.overlap import _flat, _starts, gram_rows, letter_rows

#: Lengths below which texts have signatures of so many 64-bit words; longer ones have the last number.
WORDS = ((128, 8), (512, 32), (1 << 31, 128))


def letter_signatures(text: np.ndarray, letter: np.ndarray, size: int, words: int) -> np.ndarray:
    """Parity signatures of the letters of letter_rows(), one row a text: two of them differ in no more bits than the texts' letters."""
    bit = (mix64(letter.astype(np.uint64)) >> np.uint64(20)) % np.uint64(64 * words)
    odd = (np.bincount(text * (64 * words) + bit.astype(np.int64), minlength=size * 64 * words) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(size, -1), axis=1).view(np.uint64)


@lru_cache(1024)
def places(text: str) -> dict[str, int]:
    """The places of each character as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(query: str, entry: str) -> int:
    """The length of the longest common subsequence: no matching blocks are longer together."""
    at, every = places(query), (1 << len(query)) - 1
    left = every
    for c in entry:
        if c in at:
            met = left & at[c]
            left = ((left + met) | (left - met)) & every
    return len(query) - left.bit_count()


class Alike:
    """Texts by length with their letters, 2-grams and signatures."""

    def __init__(self, plain: list[str], segs: list[str], n: int) -> None:
        self.n = n
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        self.order = np.argsort(lengths, kind="stable")
        self.size = lengths[self.order]
        self.plain = [plain[i] for i in self.order.tolist()]
        of, letter = letter_rows(self.plain)
        self.letters, self.spelled = np.unique(letter, return_inverse=True)
        self.spelt = _starts(of, len(plain))
        text, code = gram_rows([segs[i] for i in self.order.tolist()], n)
        self.codes, self.grams = np.unique(code, return_inverse=True)
        self.of_text = _starts(text, len(plain))
        self.bands, a = [], 0
        for below, words in WORDS:
            z = int(np.searchsorted(self.size, below))
            if z > a:
                lo, hi = self.spelt[a], self.spelt[z]
                parts = [letter_signatures(of[self.spelt[x] : self.spelt[min(x + 8192, z)]] - x, letter[self.spelt[x] : self.spelt[min(x + 8192, z)]], min(x + 8192, z) - x, words) for x in range(a, z, 8192)] if hi > lo else [np.zeros((z - a, words), np.uint64)]
                self.bands.append((a, z, words, np.ascontiguousarray(np.concatenate(parts).T)))
            a = z

    def found(self, plain: list[str], segs: list[str], free: list[bool], least: float):
        """For each query the texts of a ratio of at least `least` that share a gram with it (any if it is free), and the ratios."""
        of, letter = letter_rows(plain)
        spelt, common = _starts(of, len(plain)), np.searchsorted(self.letters, letter)
        held = common < len(self.letters)
        held[held] = self.letters[common[held]] == letter[held]
        asked, code = gram_rows(segs, self.n)
        at, gram = _starts(asked, len(plain)), np.searchsorted(self.codes, code)
        known = gram < len(self.codes)
        known[known] = self.codes[gram[known]] == code[known]
        signed = {words: np.concatenate([letter_signatures(of[spelt[x] : spelt[min(x + 8192, len(plain))]] - x, letter[spelt[x] : spelt[min(x + 8192, len(plain))]], min(x + 8192, len(plain)) - x, words) for x in range(0, len(plain), 8192)]) for _, _, words, _ in self.bands}
        marked, noted = np.zeros(len(self.letters) + 1, bool), np.zeros(len(self.codes) + 1, bool)
        for q, query in enumerate(plain):
            m = len(query)
            g = gram[at[q] : at[q + 1]][known[at[q] : at[q + 1]]]
            if not free[q] and not len(g):
                continue
            rows = []
            for a, z, words, signature in self.bands:
                lo = max(a, int(np.searchsorted(self.size, int(least * m / (2 - least)))))
                hi = min(z, int(np.searchsorted(self.size, int((2 - least) * m / least) + 1, "right")))
                if lo >= hi:
                    continue
                apart = np.zeros(hi - lo, np.uint16)
                for w in range(words):
                    apart += np.bitwise_count(signature[w, lo - a : hi - a] ^ signed[words][q, w])
                rows.append(lo + np.flatnonzero(apart <= (1 - least) * (m + self.size[lo:hi]) + 1e-6))
            found = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            if len(found) and m:
                mine = common[spelt[q] : spelt[q + 1]][held[spelt[q] : spelt[q + 1]]]
                marked[mine] = True
                found = found[self.size[found] > 0]
                if len(found):
                    flat, begins = _flat(self.spelt, found)
                    both = np.add.reduceat(marked[self.spelled[flat]], begins, dtype=np.int64)
                    found = found[2.0 * both >= least * (m + self.size[found]) - 1e-6]
                marked[mine] = False
            if not free[q] and len(found):
                noted[g] = True
                found = found[self.of_text[found + 1] > self.of_text[found]]
                if len(found):
                    flat, begins = _flat(self.of_text, found)
                    found = found[np.logical_or.reduceat(noted[self.grams[flat]], begins)]
                noted[g] = False
            if not len(found):
                continue
            ids, ratios = [], []
            for k in found.tolist():
                entry = self.plain[k]
                if entry == query:
                    r = 1.0
                elif 2 * common_length(query, entry) < least * (m + len(entry)) - 1e-6:
                    continue
                else:
                    r = SequenceMatcher(None, query, entry).ratio()
                if r >= least:
                    ids.append(k)
                    ratios.append(r)
            if ids:
                yield q, self.order[ids], ratios


def alike_block(n: int, least: float):
    """For cogrouped queries `q, plain, segs, free` and texts `t, plain, segs`: `q, t, r`, the pairs of a ratio of at least `least`."""

    def find(queries: pa.Table, texts: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and texts.num_rows:
            q, t = queries.column("q").to_numpy(), texts.column("t").to_numpy()
            block = Alike(texts.column("plain").to_pylist(), texts.column("segs").to_pylist(), n)
            for k, rows, ratios in block.found(*(queries.column(c).to_pylist() for c in ("plain", "segs", "free")), least):
                out[0].append(np.full(len(rows), q[k]))
                out[1].append(t[rows])
                out[2].append(ratios)
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64))], ["q", "t", "r"])

    return find
