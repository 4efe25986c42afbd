"""Evaluation texts leaking into training text: latent semantic retrieval of passages, then checks on the texts themselves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.arrays import summed
from tandemtext.functions.codepoints import fold_batch, mix64
from tandemtext.llm.shared_spans import hashed_runs, sliding_min
from tandemtext.session import durable

#: Fixed point of the latent coordinates: sums of integers are exact, so equal passages have equal vectors.
SCALE = 1 << 20
#: Fixed point of the sketch: the order in which tasks are summed changes nothing.
SKETCH = float(1 << 16)
#: Neighbouring parts that are first looked at as one.
GROUP = 4


@dataclass(frozen=True)
class Passages:
    """How texts are cut and compared.

    run: least length of a shared run of folded code points. spread: a passage begins where a hashed 4-gram is the least among
    the `spread` around it, which depends on nearby text only. Its length is run - 2 * spread - 2, so each shared run holds at
    least one whole passage that begins alike in both texts. features: hashed 3-grams; rank: latent dimensions; bits: signs
    that make a bucket; probes: near signs that are flipped to look into further buckets; cosine: least cosine of candidates.
    overlap: least part of an item that makes a paraphrase. share: least TF-IDF weight of an item's 3-grams, over that of all of
    them, in a part of a document that is looked through for one. block: distance of the places where such parts begin.
    """

    run: int = 70
    spread: int = 11
    features: int = 1 << 13
    rank: int = 16
    extra: int = 4
    bits: int = 30
    probes: int = 3
    cosine: float = 0.98
    overlap: float = 0.6
    share: float = 0.2
    block: int = 16

    @property
    def length(self) -> int:
        return self.run - 2 * self.spread - 2


def grams(points: np.ndarray, features: int) -> np.ndarray:
    """The feature of the 3-gram from each place on."""
    return (hashed_runs(points, 3, 5) >> np.uint64(20)).astype(np.int64) % features


def starts(points: np.ndarray, offsets: np.ndarray, how: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Places where passages begin, and the text of each."""
    h = hashed_runs(points, 4, 6)
    if len(h) < how.spread:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(1, int(len(points)).bit_length())
    order = ((h >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    least = (sliding_min(order, how.spread) & np.uint64((1 << bits) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    window = np.arange(len(least))
    inside = owner[window] == owner[np.minimum(window + how.spread + 2, len(points) - 1)]
    at = least[inside]  # never falls from window to window
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    fits = at + how.length <= offsets[owner[at] + 1]
    return at[fits], owner[at[fits]]


def fit_space(docs: DataFrame, how: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Document frequencies of all passages and the latent coordinates of each feature, over the whole corpus.

    One pass counts in how many passages (blocks of how.length grams) each feature stands. A second one makes the sketch
    A'A W of the TF-IDF matrix A of all passages with a random W; the randomised SVD follows from it by Nystroem's formula on
    the driver, whose size is fixed by the features and the rank. Returns idf and idf-weighted coordinates in fixed point.
    """
    d, k = how.features, how.rank + how.extra

    def blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
        points, offsets = fold_batch(batch.column("t").to_pylist())
        f = grams(points, d)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(f)]
        place = np.arange(len(f)) - offsets[owner]
        new = np.ones(len(f), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] % how.length == 0)
        return f, np.cumsum(new) - 1, int(new.sum())

    def count(total: np.ndarray, batch: pa.RecordBatch) -> None:
        f, block, n = blocks(batch)
        both = np.sort(block * d + f)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        total[:d] += np.bincount(both % d, minlength=d)
        total[d] += n

    counts = summed(docs, lambda: np.zeros(d + 1, np.int64), count)
    idf = np.log((counts[d] + 1) / (counts[:d] + 1)).astype(np.float32)
    w = np.random.default_rng(3).standard_normal((d, k)).astype(np.float32)
    weighted = docs.sparkSession.sparkContext.broadcast((idf, idf[:, None] * w))  # features * rank numbers, fixed

    def sketch(total: np.ndarray, batch: pa.RecordBatch) -> None:
        idf, iw = weighted.value
        f, block, n = blocks(batch)
        for a in range(0, n, 4096):
            lo, hi = np.searchsorted(block, [a, a + 4096])
            part, mine = f[lo:hi], block[lo:hi] - a
            begin = np.nonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))[0] if len(mine) else np.zeros(0, np.int64)
            if not len(begin):
                continue
            aw = np.add.reduceat(iw[part], begin, axis=0)  # rows of A W
            norm = np.sqrt(np.add.reduceat(idf[part] ** 2, begin)) + 1e-6
            scaled = (aw / norm[:, None] ** 2)[np.cumsum(np.concatenate([[0], mine[1:] != mine[:-1]]))]
            order = np.argsort(part.astype(np.uint16), kind="stable") if d <= 1 << 16 else np.argsort(part, kind="stable")
            first = np.nonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))[0]
            sums = np.add.reduceat(scaled[order].astype(np.float64), first, axis=0)
            total[part[order][first]] += np.round(sums * SKETCH).astype(np.int64)

    y = summed(docs, lambda: np.zeros((d, k), np.int64), sketch) / SKETCH * idf[:, None].astype(np.float64)
    nu = 1e-6 * max(np.linalg.norm(y), 1e-9)
    y += nu * w
    gram = w.T.astype(np.float64) @ y
    lower = np.linalg.cholesky((gram + gram.T) / 2 + 1e-9 * np.trace(np.abs(gram)) * np.eye(k) / k)
    u, _, _ = np.linalg.svd(np.linalg.solve(lower, y.T).T, full_matrices=False)
    return idf, np.round(u[:, : how.rank] * np.sqrt(d) * idf[:, None] * SCALE / 16).astype(np.int64)


def latent(points: np.ndarray, at: np.ndarray, coordinates: np.ndarray, how: Passages) -> np.ndarray:
    """The latent vectors of the passages beginning at these places, as exact integer sums; equal passages have equal vectors."""
    f = grams(points, how.features)
    out = np.empty((len(at), coordinates.shape[1]), np.int64)
    total = np.zeros(len(f) + 1, np.int64)
    for k in range(coordinates.shape[1]):
        np.cumsum(coordinates[:, k][f], out=total[1:])
        out[:, k] = total[at + how.length - 2] - total[at]
    return out


class Retriever:
    """The passages of the evaluation items by their buckets of latent signs."""

    def __init__(self, items: list[tuple[int, str, str]], coordinates: np.ndarray, how: Passages) -> None:
        self.how, self.coordinates = how, coordinates
        self.ids = [i for i, _, _ in items]
        self.points, self.offsets = fold_batch([t for _, t, _ in items])
        self.whole = self.points.tobytes().decode("utf-32-le", "surrogatepass")
        self.answers = [fold_batch([a])[0].tobytes().decode("utf-32-le", "surrogatepass") for _, _, a in items]
        self.at, self.owner = starts(self.points, self.offsets, how)
        planes = np.random.default_rng(4).standard_normal((coordinates.shape[1], how.bits)).astype(np.float32)
        self.planes = planes
        vectors = latent(self.points, self.at, coordinates, how)
        self.unit, self.zero = self._unit(vectors), ~vectors.any(axis=1)
        side = self.unit @ planes
        code = self._code(side)
        near = np.argsort(np.abs(side), axis=1)[:, : how.probes]
        codes = [code] + [code ^ (np.uint64(1) << near[:, p].astype(np.uint64)) for p in range(near.shape[1])]
        every = np.concatenate(codes)
        place = np.tile(np.arange(len(self.at)), len(codes))
        order = np.argsort(every, kind="stable")
        self.codes, self.places = every[order], place[order]

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(np.float32)
        return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-6)

    def _code(self, side: np.ndarray) -> np.ndarray:
        return ((side > 0).astype(np.uint64) << np.arange(side.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def search(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates: the place in the batch, the item passage, and the cosine, for all passages of the texts."""
        at, _ = starts(points, offsets, self.how)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(at), 50_000):
            some = at[a : a + 50_000]
            vectors = latent(points[some[0] : some[-1] + self.how.length], some - some[0], self.coordinates, self.how)
            unit, zero = self._unit(vectors), ~vectors.any(axis=1)
            code = self._code(unit @ self.planes)
            lo, hi = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
            n = hi - lo
            ends, x = np.cumsum(n), 0
            while x < len(some):  # texts that repeat a short piece meet themselves at many places: 2 million at a time
                z = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + 2_000_000, "right")))
                part = n[x:z]
                row = np.repeat(np.arange(x, z), part)
                item = self.places[np.repeat(lo[x:z], part) + np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)]
                cosine = (unit[row] * self.unit[item]).sum(axis=1)
                cosine[zero[row] & self.zero[item]] = 1.0  # passages of nothing but features that are everywhere
                keep = cosine >= self.how.cosine
                found.append((some[row[keep]], item[keep], cosine[keep]))
                x = z
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


class Paraphrases:
    """Parts of documents that share much of an item's TF-IDF weight, and their longest common subsequences with it.

    A part is as long as one and a half items and begins at every how.block-th code point. Its share is summed over blocks from
    the items of each feature, so that all parts and items are compared, without buckets.
    """

    def __init__(self, points: np.ndarray, offsets: np.ndarray, whole: str, idf: np.ndarray, how: Passages) -> None:
        self.how, self.size = how, np.diff(offsets)
        self.texts = [whole[offsets[i] : offsets[i + 1]] for i in range(len(self.size))]
        owner = np.repeat(np.arange(len(self.size)), self.size)[: max(0, len(points) - 2)]
        f = grams(points, how.features)
        inside = np.arange(len(f)) + 2 < offsets[1:][owner] if len(f) else np.zeros(0, bool)
        both = np.unique(f[inside] * len(self.size) + owner[inside])
        f, self.items = both // max(1, len(self.size)), both % max(1, len(self.size))
        self.first = np.searchsorted(f, np.arange(how.features + 1))
        weight = idf.astype(np.float64) ** 2
        self.weight = weight[f]
        self.least = np.maximum(how.share * np.bincount(self.items, self.weight, len(self.size)), 1e-9)
        self.reach = -(-(self.size + self.size // 2) // how.block) + 1  # blocks that hold a part, wherever it begins in the first
        self.masks: list[dict[str, int]] = []
        for t in self.texts:
            places: dict[str, int] = {}
            for i, ch in enumerate(t):
                places[ch] = places.get(ch, 0) | 1 << i
            self.masks.append(places)

    def search(self, points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The documents with candidates, the blocks where their parts begin, and their items."""
        n, block = len(self.size), self.how.block
        size = np.diff(offsets)
        blocks = -(-size // block)
        ends = np.cumsum(blocks)
        f = grams(points, self.how.features)
        a = 0
        while a < len(size) and n:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + max(1, 2_000_000 // n), "right")))
            at = np.arange(offsets[a], min(offsets[z], len(f)))
            doc = np.repeat(np.arange(a, z), size[a:z])[: len(at)]
            at, doc = at[at + 2 < offsets[doc + 1]], doc[at + 2 < offsets[doc + 1]]
            base = ends[a] - blocks[a]
            row = ends[doc] - blocks[doc] - base + (at - offsets[doc]) // block
            lo = self.first[f[at]]
            times = self.first[f[at] + 1] - lo
            place = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            total = int(ends[z - 1] - base)
            sums = np.zeros((total + 1, n))
            sums[1:] = np.bincount(np.repeat(row, times) * n + self.items[place], self.weight[place], total * n).reshape(total, n)
            np.cumsum(sums, axis=0, out=sums)
            of = np.repeat(np.arange(a, z), blocks[a:z])
            last = ends[of] - base
            rows, items = [], []
            for reach in np.unique(self.reach):
                mine = np.nonzero(self.reach == reach)[0]
                part = sums[:, mine]
                r, i = np.nonzero(part[np.minimum(np.arange(total) + reach, last)] - part[:-1] >= self.least[mine])
                rows.append(r)
                items.append(mine[i])
            r, i = np.concatenate(rows), np.concatenate(items)
            order = np.argsort(r, kind="stable")
            r, i = r[order], i[order]
            fit = (size[of[r]] >= self.how.overlap * self.size[i]) & (self.size[i] > 0)
            r, i = r[fit], i[fit]
            new = np.nonzero(np.diff(of[r], prepend=-1))[0]
            for x, y in zip(new, np.append(new[1:], len(r))[: len(new)], strict=True):
                d = int(of[r[x]])
                yield d, r[x:y] - int(ends[d] - blocks[d] - base), i[x:y]
            a = z

    def overlaps(self, text: str, blocks: np.ndarray, items: np.ndarray) -> dict[int, float]:
        """For each item that may reach how.overlap the largest part of it that is a subsequence of one of the text's parts.

        Parts that begin near each other are first taken as one long part: what is no subsequence of that is none of its parts, so
        an item that stays below there is settled for all of them.
        """
        wide = self._subsequences(text, blocks // GROUP * GROUP, items, (GROUP - 1) * self.how.block)
        near = np.fromiter((wide[b, i] >= self.how.overlap * self.size[i] for b, i in zip((blocks // GROUP * GROUP).tolist(), items.tolist(), strict=True)), bool, len(items))
        best: dict[int, float] = {}
        for (_, i), common in self._subsequences(text, blocks[near], items[near], 0).items():
            best[i] = max(best.get(i, 0.0), common / int(self.size[i]))
        return best

    def _subsequences(self, text: str, blocks: np.ndarray, items: np.ndarray, more: int) -> dict[tuple[int, int], int]:
        """Lengths of the longest common subsequences of items and the parts that begin at their blocks, `more` code points longer.

        The items of a block lie side by side in one number, the longest lowest, a free bit above each takes its carry.
        """
        out: dict[tuple[int, int], int] = {}
        order = np.lexsort((-self.size[items], blocks))
        blocks, items = blocks[order], items[order]
        letters: dict[int, dict[str, int]] = {}
        used = set(text)
        for i in np.unique(items).tolist():
            letters[i] = {ch: m for ch, m in self.masks[i].items() if ch in used}
        first = np.nonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))[0] if len(blocks) else np.zeros(0, np.int64)
        made: dict[tuple[int, ...], tuple[dict[str, int], list[int], list[int]]] = {}
        for x, z in zip(first.tolist(), np.append(first[1:], len(blocks)).tolist(), strict=False):
            b, chosen = int(blocks[x]), tuple(dict.fromkeys(items[x:z].tolist()))
            if chosen not in made:
                places, shift, full, upto = {}, 0, [0], [0]
                for i in chosen:
                    for ch, m in letters[i].items():
                        places[ch] = places.get(ch, 0) | m << shift
                    full.append(full[-1] | ((1 << int(self.size[i])) - 1) << shift)
                    shift += int(self.size[i]) + 1
                    upto.append(shift)
                if len(made) > 16:
                    made.clear()
                made[chosen] = places, full, upto
            places, full, upto = made[chosen]
            k, v, done, a = len(chosen), full[-1], 0, b * self.how.block
            while k:  # the shortest is ready first
                i = chosen[k - 1]
                n, keep = int(self.size[i]), full[k]
                stop = n + n // 2 + more
                for ch in text[a + done : a + stop]:
                    m = places.get(ch)
                    if m:
                        u = v & m
                        v = ((v + u) | (v - u)) & keep
                done = max(done, stop)
                out[b, i] = n - (v >> upto[k - 1]).bit_count()
                k -= 1
                v &= full[k]
        return out


def common_run(a: str, i: int, b: str, j: int) -> tuple[int, int]:
    """Where in `a` the longest run begins that two texts share along the diagonal through these places, around a common character, and its end."""
    if i >= len(a) or j >= len(b) or a[i] != b[j]:
        return i, i
    x = 0
    while x < min(i, j) and a[i - x - 1] == b[j - x - 1]:
        x += 1
    y = 0
    while y < min(len(a) - i, len(b) - j) and a[i + y] == b[j + y]:
        y += 1
    return i - x, i + y


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel counting."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & places.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str = "answer", how: Passages | None = None, most_items: int = 20_000, overlaps: bool = True) -> DataFrame:
    """Documents that carry passages of evaluation items: `doc_id, item_id, run, overlap, answered, cosine`.

    Passages begin at places chosen by their own text and are embedded by TF-IDF and a randomised SVD fitted over the whole
    corpus. A candidate is a document passage in the bucket (or a near one) of an item passage with a cosine over the
    threshold; as equal passages have equal vectors, none that holds a shared run of how.run code points is missed. Each candidate
    is checked on the folded texts: `run` is the longest common run found through its passages, `overlap` the longest common
    subsequence of the item and a part of the document one and a half times as long, over the item's length, `answered` whether
    the item's answer stands in the document. Rows have a run of at least how.run, or an overlap of how.overlap (a paraphrase).

    The latent vectors of texts made of few patterns are too alike to tell a paraphrase, so the parts looked through for overlaps
    are chosen by TF-IDF before the reduction (Paraphrases); a part with less than how.share of an item's weight is not looked
    at. Where no passage was found, `run` is 0 and `cosine` null. overlaps=False gives the rows with a run only, `overlap` null.

    The items are collected and broadcast behind a check: above `most_items` items, or 64 million characters, they are searched in
    blocks of that size, one pass over the corpus each. Null and empty texts carry nothing; items shorter than a passage are never found; items with
    a null id are left out. Repeated items are reported each. Other columns are ignored. Empty tables give no rows.
    """
    how = how or Passages()
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"), F.coalesce(F.col(answer), F.lit("")).alias("a")).where("i is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    parts = max(1, -(-n // most_items), -(-chars // 64_000_000))
    idf, coordinates = fit_space(corpus, how)
    out = None
    for part in range(parts):
        some = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        found = _search(corpus, [tuple(r) for r in some.orderBy("i").collect()], coordinates, idf if overlaps else None, how)
        out = found if out is None else out.unionByName(found)
    return durable(out, "leaks")


def _search(corpus: DataFrame, items: list[tuple[int, str, str]], coordinates: np.ndarray, idf: np.ndarray | None, how: Passages) -> DataFrame:
    """idf: where overlaps are wanted, the weights of the features."""
    shared = corpus.sparkSession.sparkContext.broadcast((items, coordinates, idf))
    made: list[tuple[Retriever, Paraphrases | None]] = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            r = Retriever(*shared.value[:2], how)
            made.append((r, None if idf is None else Paraphrases(r.points, r.offsets, r.whole, shared.value[2], how)))
        retriever, paraphrases = made[0]
        for b in batches:
            points, offsets = fold_batch(b.column("t").to_pylist())
            at, passage, cosine = retriever.search(points, offsets)
            rows: dict[tuple[int, int], list] = {}
            whole = points.tobytes().decode("utf-32-le", "surrogatepass")
            doc = np.searchsorted(offsets, at, "right") - 1
            item = retriever.owner[passage] if len(at) else passage
            places: dict[int, set[tuple[int, int]]] = {}
            covered: dict[tuple[int, int, int], tuple[int, int]] = {}  # the last run on each diagonal
            for place, p, c, d, i in zip(at.tolist(), passage.tolist(), cosine.tolist(), doc.tolist(), item.tolist(), strict=True):
                o, q = int(offsets[d]), int(retriever.offsets[i])
                a, z = whole[o : int(offsets[d + 1])], retriever.whole[q : int(retriever.offsets[i + 1])]
                best = rows.setdefault((d, i), [0, None, 0.0])
                x, y = place - o, int(retriever.at[p]) - q
                if paraphrases:  # the parts that hold the item if it lies around this passage
                    places.setdefault(d, set()).update((k, i) for k in range(max(0, (x - y - len(z) // 2) // how.block), max(0, x - y) // how.block + 1))
                begin, end = covered.get((d, i, x - y), (0, 0))
                if not begin <= x < end:
                    begin, end = covered[d, i, x - y] = common_run(a, x, z, y)
                    best[0] = max(best[0], end - begin)
                best[2] = max(best[2], c)
            if paraphrases:
                for d, blocks, found in paraphrases.search(points, offsets):
                    places.setdefault(d, set()).update(zip(blocks.tolist(), found.tolist(), strict=True))
                for d, some in places.items():
                    blocks, found = np.array(sorted(some)).T
                    for i, overlap in paraphrases.overlaps(whole[int(offsets[d]) : int(offsets[d + 1])], blocks, found).items():
                        rows.setdefault((d, i), [0, None, None])[1] = overlap
            out: list[tuple] = []
            ids = b.column("id").to_pylist()
            for (d, i), (run, overlap, c) in rows.items():
                if run >= how.run or (overlap or 0) >= how.overlap:
                    a = whole[int(offsets[d]) : int(offsets[d + 1])]
                    out.append((ids[d], retriever.ids[i], run, overlap, bool(retriever.answers[i]) and retriever.answers[i] in a, c))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "run", "overlap", "answered", "cosine"])

    return corpus.mapInArrow(scan, "doc_id bigint, item_id bigint, run int, overlap double, answered boolean, cosine double")
