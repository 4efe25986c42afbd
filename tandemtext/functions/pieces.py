"""Numpy kernel that finds the fragments of many queries in one block of small layers."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa

from tandemtext.functions.overlap import BITS, BREAK, _flat, _starts, both_rows
from tandemtext.functions.text import WEAK_END, WEAK_START
from tandemtext.functions.vectorized import JUNK, longest_fragment

#: Characters of the runs that are looked up: no fragment is shorter.
RUN = 4
_WEAK = re.compile(f"{WEAK_START}|{WEAK_END}")
_FOURTH = Decimal("0.0001")


def bround4(x: np.ndarray) -> np.ndarray:
    """Rounded to four places as Spark's bround does, ties by decimal form."""
    scaled = x * 1e4
    out = np.rint(scaled) / 1e4
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(_FOURTH, ROUND_HALF_EVEN))
    return out


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)


def _lookup(known: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The place of each code among the known ones, -2 if it isn't."""
    at = np.searchsorted(known, code)
    at[at == len(known)] = 0
    return np.where(known[at] == code, at, -2) if len(known) else np.full(len(code), -2)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by the columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _ranks(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """Each value's number in order of code points, -1 for null, and the values."""
    coded = column.combine_chunks().dictionary_encode()
    values = coded.dictionary.to_pylist()
    order = sorted(range(len(values)), key=values.__getitem__)
    rank = np.full(len(values) + 1, -1)
    rank[order] = np.arange(len(values))
    return rank[coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)], [values[i] for i in order]


class Layers:
    """Entries of whole layers, by layer and text, with the weights of their grams and the places of their runs."""

    def __init__(self, entries: pa.Table) -> None:
        number = lambda c: entries.column(c).to_numpy()
        order = np.lexsort((number("e"), number("s"), number("own")))
        entries = entries.take(pa.array(order)).combine_chunks()
        own, s, self.e = number("own"), number("s"), number("e")
        new = _firsts(own, s)
        first = np.flatnonzero(new)
        self.of_text, self.s = np.append(first, len(own)), s[first]
        self.segs = entries.column("segs").take(pa.array(first)).to_pylist()
        begin = _firsts(own[first])
        self.layer, self.own = np.cumsum(begin) - 1, own[first][begin]
        self.place, self.at, self.no, self.runtime = number("place"), number("at"), number("no"), entries.column("runtime").to_numpy(zero_copy_only=False)
        self.dt, self.shown = np.unique(number("dt"), return_inverse=True)
        self.target, values = _ranks(entries.column("target"))
        self.targets = len(values) + 1
        file, names = _ranks(entries.column("file"))
        self.order = np.empty(len(own), np.int64)
        self.order[np.lexsort((self.e, _ranks(entries.column("source"))[0], file))] = np.arange(len(own))
        self.names = len(names) + 1
        named = np.unique(((np.cumsum(new) - 1) * self.names + file)[file != (names.index("") if "" in names else -1)])
        self.file, self.of_file = named % self.names, _starts(named // self.names, len(first))
        self._runs()
        self._weights(np.diff(self.of_text))

    def _runs(self) -> None:
        points = _points(self.segs)
        size = max(len(points) - RUN + 1, 0)
        self.text = np.repeat(np.arange(len(self.segs)), np.fromiter(map(len, self.segs), np.int64, len(self.segs)) + 1)
        broken = points == BREAK
        self.seg = np.cumsum(broken) - broken
        ends = np.flatnonzero(broken)
        self.length = np.diff(np.concatenate([[-1], ends])) - 1
        self.first_seg = self.seg[np.flatnonzero(_firsts(self.text))]
        self.segments = int((self.seg - self.first_seg[self.text]).max(initial=0)) + 1
        self.junk = np.zeros(len(self.segs), bool)
        self.junk[self.text[ends[self.length >= JUNK]]] = True
        inside, code = self._three(points, size)
        self.threes = np.unique(code[inside])
        code = np.where(inside, _lookup(self.threes, code) << BITS | points[RUN - 1 : RUN - 1 + size], -1)
        self.fours, gram = np.unique(code[inside], return_inverse=True)
        at = np.flatnonzero(inside)
        self.gram = np.full(len(points) + 1, -1)
        self.gram[at] = gram
        order = np.argsort(gram, kind="stable")
        self.posted, self.of_four = at[order], _starts(gram, len(self.fours))

    @staticmethod
    def _three(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of RUN characters begin, and the codes of the three characters there."""
        inside, code = np.ones(size, bool), np.zeros(size, np.int64)
        for i in range(RUN):
            part = points[i : i + size]
            inside &= part != BREAK
            if i < RUN - 1:
                code = code << BITS | part
        return inside, code

    def _weights(self, n: np.ndarray) -> None:
        """Each text's grams weigh by the entries of its layer that have them."""
        text, code = both_rows(self.segs)
        total = np.bincount(self.layer, n, len(self.own)) + 1
        order = np.lexsort((code, self.layer[text]))
        t, c = text[order], code[order]
        new = _firsts(self.layer[t], c)
        df = np.add.reduceat(n[t], np.flatnonzero(new)) if len(t) else np.zeros(0, np.int64)
        weight = np.log(total[self.layer[t]] / (df[np.cumsum(new) - 1] + 1)) + 1
        order = np.argsort(c, kind="stable")
        self.held, self.weight, c = t[order], weight[order], c[order]
        new = _firsts(c)
        self.codes, self.of_code = c[new], np.append(np.flatnonzero(new), len(c))

    def pieces(self, queries: pa.Table, top: int):
        """For each query, as its number: entries, fragments by number with their texts, scores, supporting texts and files, ranks and the query's length."""
        segs = queries.column("segs").to_pylist()
        points = _points(segs)
        inside, code = self._three(points, max(len(points) - RUN + 1, 0))
        three = _lookup(self.threes, code)
        asked = np.full(len(points) + 2, -2)
        asked[1 : 1 + len(code)] = np.where(inside & (three >= 0), _lookup(self.fours, three << BITS | points[RUN - 1 :][: len(code)]), -2)  # one place later
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, segs), np.int64, len(segs)) + 1)]).tolist()
        seg = np.cumsum(points == BREAK)
        of, code = both_rows(segs)
        gram, grams = _lookup(self.codes, code), _starts(of, len(segs))
        lists = {c: (x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])) for c in ("ex", "since", "strong") for x in [queries.column(c).combine_chunks()]}
        barred = np.zeros(len(self.own), bool)
        for q, query in enumerate(segs):
            a, z = begin[q], begin[q] + len(query)
            known = np.flatnonzero(asked[a + 1 : z + 1] >= 0)
            if not len(known):
                continue
            listed = lambda c: lists[c][0][lists[c][1][q] : lists[c][1][q + 1]]  # noqa: B023, E731
            strong = _lookup(self.own, listed("strong"))
            strong = strong[strong >= 0]
            g = gram[grams[q] : grams[q + 1]]
            barred[strong] = True
            out = self._query(query, asked[a : z + 2], seg[a:z] - seg[a], known, g[g >= 0], barred, listed("ex"), listed("since"), top)
            barred[strong] = False
            if out is not None:
                yield q, *out

    def _query(self, query: str, asked: np.ndarray, seg: np.ndarray, known: np.ndarray, grams: np.ndarray, barred: np.ndarray, ex: np.ndarray, since: np.ndarray, top: int):
        # all longest runs that the query shares with each text, the text's best one first
        g = asked[known + 1]
        lo, hi = self.of_four[g], self.of_four[g + 1]
        p, i = np.concatenate([self.posted[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]), np.repeat(known, hi - lo)
        begins = self.gram[p - 1] != asked[i]
        p, i = p[begins], i[begins]
        size = np.full(len(p), RUN)
        alive, k = np.arange(len(p)), 0
        while len(alive):
            k += 1
            alive = alive[self.gram[p[alive] + k] == asked[np.minimum(i[alive] + k + 1, len(asked) - 1)]]
            size[alive] += 1
        text, yseg = self.text[p], self.seg[p]
        widths = [len(self.segs).bit_length(), len(query).bit_length(), int(seg[-1] + 1).bit_length(), self.segments.bit_length(), len(query).bit_length()]
        keys = [text, len(query) - size, seg[i], yseg - self.first_seg[text], i]
        if sum(widths) < 63:
            packed = keys[0]
            for key, width in zip(keys[1:], widths[1:], strict=True):
                packed = packed << width | key
            order = np.argsort(packed)
        else:
            order = np.lexsort(keys[::-1])
        run_t, run_n, run_i = text[order], size[order], i[order]
        new = np.flatnonzero(_firsts(run_t))
        t, n, i, y = run_t[new], run_n[new], run_i[new], self.length[yseg[order[new]]]
        for k in np.flatnonzero(self.junk[t]).tolist():
            fragment, other = longest_fragment(query.split("\n"), self.segs[t[k]].split("\n"), RUN)
            n[k], i[k], y[k] = len(fragment), query.find(fragment), len(other)
        # fragments by number
        width = len(query) + 1
        spans, of = np.unique(i * width + n, return_inverse=True)
        ids: dict[str, int] = {}
        number = np.array([ids.setdefault(query[c // width : c // width + c % width], len(ids)) for c in spans.tolist()])[of]
        names = list(ids)
        weak = np.array([len(x) < RUN or bool(_WEAK.search(x)) for x in names])
        layer_of = self.layer[t]
        keep = np.flatnonzero(~weak[number] & ~barred[layer_of])
        if not len(keep):
            return None
        met = np.bincount(layer_of, minlength=len(self.own))
        t, n, i, y, number, layer = t[keep], n[keep], i[keep], y[keep], number[keep], layer_of[keep]
        sources, files = self._support(t, n, i, np.flatnonzero(met[layer] > 1), layer, run_t, run_n, run_i)
        held = np.concatenate([self.held[a:b] for a, b in zip(self.of_code[grams].tolist(), self.of_code[grams + 1].tolist(), strict=True)])
        weights = np.concatenate([self.weight[a:b] for a, b in zip(self.of_code[grams].tolist(), self.of_code[grams + 1].tolist(), strict=True)])
        idf = np.round(np.bincount(held, weights, len(self.segs))[t], 9)
        m = len(query) - int(seg[-1])
        score = bround4(idf + n * 2.0 + n / max(m, 1) * 10.0 + n / np.maximum(y, 1) * 2.0 + sources * 1.25 + files * 0.75)
        # entries
        row, _ = _flat(self.of_text, t)
        of = np.repeat(np.arange(len(t)), self.of_text[t + 1] - self.of_text[t])
        if len(ex):
            at = _lookup(ex, self.s[t])
            until = np.where(at >= 0, since.astype(np.int64)[np.maximum(at, 0)], np.iinfo(np.int64).max)[of]
            fine = until > self.place[row]
            row, of = row[fine], of[fine]
            if not len(row):
                return None
        rank = np.ones(len(row), np.int64)
        several = np.bincount(layer[of], minlength=len(self.own))[layer[of]] > 1
        if several.any():
            r, o, k = self._ranked(row[several], of[several], layer, number, score, sources, files, n, i, names, query, top)
            row, of, rank = np.concatenate([row[~several], r]), np.concatenate([of[~several], o]), np.concatenate([rank[~several], k])
        # of runtime entries the best with one fragment and target
        late = self.runtime[row]
        key = number[of] * len(self.dt) + self.shown[row]
        order = np.lexsort((rank, self.no[row], -self.at[row], -score[of], key, ~late))
        best = order[_firsts(key[order], late[order]) | ~late[order]]
        row, of, rank = row[best], of[best], rank[best]
        return self.e[row], number[of], names, score[of], sources[of], files[of], rank, self.dt[self.shown[row]], self.at[row], self.no[row], self.runtime[row], m

    def _support(self, t: np.ndarray, n: np.ndarray, i: np.ndarray, several: np.ndarray, layer: np.ndarray, run_t: np.ndarray, run_n: np.ndarray, run_i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of its layer that hold each fragment, and their files: of those with runs in common, the ones with a run over the fragment's place in the query."""
        sources, files = np.ones(len(t), np.int64), np.diff(self.of_file)[t]
        if len(several):
            of_layer = _starts(self.layer[run_t], len(self.own))
            at, _ = _flat(of_layer, layer[several])
            who = np.repeat(several, of_layer[layer[several] + 1] - of_layer[layer[several]])
            over = (run_i[at] <= i[who]) & (run_i[at] + run_n[at] >= i[who] + n[who])
            who, other = who[over], run_t[at[over]]
            new = _firsts(who, other)
            who, other = who[new], other[new]
            sources[several] = np.bincount(who, minlength=len(t))[several]
            count = self.of_file[other + 1] - self.of_file[other]
            pairs = np.repeat(who, count) * self.names
            if len(pairs):
                pairs = np.unique(pairs + self.file[_flat(self.of_file, other)[0]])
            files[several] = np.bincount(pairs // self.names, minlength=len(t))[several]
        return sources, files

    def _ranked(self, row, of, layer, number, score, sources, files, n, i, names, query, top):
        """The first entries of layers with several: one for each fragment and target, none in a fragment that scores as much."""
        order = np.lexsort((self.order[row], -n[of], -sources[of], -files[of], -score[of], layer[of]))
        row, of = row[order], of[order]
        _, once = np.unique((layer[of] * len(names) + number[of]) * self.targets + self.target[row] + 1, return_index=True)
        once.sort()
        row, of = row[once], of[once]
        own = layer[of]
        starts = np.append(np.flatnonzero(_firsts(own)), len(own))
        group = np.cumsum(_firsts(own)) - 1
        b, _ = _flat(starts, group)
        a = np.repeat(np.arange(len(row)), np.diff(starts)[group])
        fit = (a != b) & (score[of[b]] >= score[of[a]]) & (n[of[b]] >= n[of[a]]) & (self.target[row[a]] >= 0)
        a, b = a[fit], b[fit]
        x, z = of[a], of[b]
        nested = (number[x] == number[z]) | (i[z] <= i[x]) & (i[x] + n[x] <= i[z] + n[z])
        repeated = np.array([query.find(f, query.find(f) + 1) >= 0 for f in names])
        for k in np.flatnonzero(~nested & repeated[number[x]]).tolist():
            nested[k] = names[number[x[k]]] in names[number[z[k]]]
        left = np.ones(len(row), bool)
        left[a[nested]] = False
        row, of, own = row[left], of[left], own[left]
        new = np.flatnonzero(_firsts(own))
        rank = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row)))) + 1
        few = rank <= top
        return row[few], of[few], rank[few]


def piece_block(top: int):
    """For cogrouped queries `q, segs, ex, since, strong` and entries of whole layers the fragments of each query: `q, e, fragment, score, m, sources, files, rank, dt, at, no, runtime`.

    Of runtime entries with one fragment and shown target only the block's best one is given.
    """

    def find(queries: pa.Table, entries: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(12)]
        fragments: list[str] = []
        if queries.num_rows and entries.num_rows:
            ids = queries.column("q").to_numpy()
            for q, e, number, names, score, sources, files, rank, dt, at, no, runtime, m in Layers(entries).pieces(queries, top):
                for c, x in zip(columns, (np.full(len(e), ids[q]), e, (number + len(fragments)).astype(np.int32), score, np.full(len(e), m, np.int32), sources.astype(np.int32), files.astype(np.int32), rank.astype(np.int32), dt, at, no, runtime), strict=True):
                    c.append(x)
                fragments += names
        kinds = (np.int64, np.int64, np.int32, np.float64, np.int32, np.int32, np.int32, np.int32, np.int64, np.int32, np.int32, np.bool_)
        arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, kind)) for c, kind in zip(columns, kinds, strict=True)]
        arrays[2] = pa.array(fragments, pa.string()).take(arrays[2])
        return pa.table(arrays, ["q", "e", "fragment", "score", "m", "sources", "files", "rank", "dt", "at", "no", "runtime"])

    return find
