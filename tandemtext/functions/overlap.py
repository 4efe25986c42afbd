"""Numpy kernels that count shared n-grams of many queries and one block of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BREAK, BITS = 10, 21
#: Scores are whole numbers of so many parts of one.
PARTS = 1e9
#: A text that may be in a pool: its id, number of entries, shared grams (or their score), length, the place of the first shared gram among the query's, and whether its similarity can be enough.
FOUND = np.dtype([("t", "i8"), ("n", "i2"), ("shared", "i8"), ("size", "i4"), ("first", "i4"), ("may", "?")])


def gram_rows(segs: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams inside the segments of each text (joined by line breaks) as text numbers and codes, by text, then code.

    A code holds a gram's code points, so codes are in the grams' order.
    """
    lengths = np.fromiter(map(len, segs), np.int64, len(segs)) + 1
    points = np.frombuffer("\n".join([*segs, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(points) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(points) - n + 1
    code, inside = np.zeros(size, np.int64), np.ones(size, bool)
    for i in range(n):
        part = points[i : i + size]
        code = code << BITS | part
        inside &= part != BREAK
    text, code = np.repeat(np.arange(len(segs)), lengths)[:size][inside], code[inside]
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
    return text[new], code[new]


def both_rows(segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 3- and 2-grams of each text as text numbers and codes, by text: codes of 2-grams are negative."""
    text, code = (np.concatenate(x) for x in zip(gram_rows(segs, 3), (lambda t, c: (t, ~c))(*gram_rows(segs, 2)), strict=True))
    order = np.lexsort((code, text))
    return text[order], code[order]


def letter_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each text as text numbers and codes, by text: a character's second place has another code than its first."""
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    order = np.lexsort((points, text))
    text, points = text[order], points[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (points[1:] != points[:-1])
    place = np.arange(len(text))
    return text, points << 32 | (place - np.maximum.accumulate(np.where(new, place, 0)))


def _flat(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the elements of some rows, one row after another, and where each row begins in them."""
    a, b = starts[rows], starts[rows + 1]
    ends = np.cumsum(b - a)
    return np.arange(ends[-1]) + np.repeat(a - (ends - (b - a)), b - a), ends - (b - a)


def _starts(rows: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))])


class Block:
    """Texts with their grams, by gram and by text."""

    def __init__(self, segs: list[str], t: np.ndarray, size: np.ndarray, entries: np.ndarray, n: int, plain: list[str] | None = None) -> None:
        self.t, self.size, self.entries, self.n = t, size, entries, n
        text, code = gram_rows(segs, n)
        self.codes, self.grams = np.unique(code, return_inverse=True)
        self.of_text = _starts(text, len(segs))
        self.of_gram = _starts(self.grams, len(self.codes))
        self.texts = text[np.argsort(self.grams, kind="stable")]
        if plain is not None:
            of, letter = letter_rows(plain)
            self.letters, self.spelled = np.unique(letter, return_inverse=True)
            self.spelt = _starts(of, len(plain))

    def shared(self, queries: list[str], most: int, plain: list[str] | None = None, least: float = 0.0) -> Iterator[tuple[int, bytes, bool]]:
        """For each query that shares a gram the first `most` texts by shared grams, length, first shared gram and id, and whether there are more.

        With `plain`, the texts as compared, `may` is false where the characters in common keep the similarity under `least`.
        """
        asked, code = gram_rows(queries, self.n)
        at = _starts(asked, len(queries))
        gram = np.searchsorted(self.codes, code)
        known = gram < len(self.codes)
        known[known] = self.codes[gram[known]] == code[known]
        place = np.full(len(self.codes) + 1, np.iinfo(np.int32).max, np.int32)
        lo, hi = self.of_gram[:-1].tolist(), self.of_gram[1:].tolist()
        if plain is not None:
            of, letter = letter_rows(plain)
            spelt, common = _starts(of, len(plain)), np.searchsorted(self.letters, letter)
            held = common < len(self.letters)
            held[held] = self.letters[common[held]] == letter[held]
            marked = np.zeros(len(self.letters), bool)
        for q in range(len(queries)):
            own = known[at[q] : at[q + 1]]
            g = gram[at[q] : at[q + 1]][own]
            if not len(g):
                continue
            counts = np.bincount(np.concatenate([self.texts[lo[x] : hi[x]] for x in g.tolist()]), minlength=len(self.t))
            level = np.cumsum(np.bincount(counts)[:0:-1])  # texts with at least so many grams, from the highest number down
            low = len(level) - int(np.searchsorted(level, most)) if level[-1] >= most else 1
            found = np.flatnonzero(counts >= low)
            more = level[-1] > most
            if len(found) > most:  # of those that only just share enough, the shortest
                tied = counts[found] == low
                room = most - int((~tied).sum())
                sizes = self.size[found]
                found = found[~tied | (sizes <= np.partition(sizes[tied], room - 1)[room - 1])]
            place[g] = np.flatnonzero(own)
            flat, begins = _flat(self.of_text, found)
            out = np.empty(len(found), FOUND)
            out["first"] = np.minimum.reduceat(place[self.grams[flat]], begins)
            place[g] = np.iinfo(np.int32).max
            out["t"], out["n"], out["shared"], out["size"] = self.t[found], self.entries[found], counts[found], self.size[found]
            out["may"] = True
            if plain is not None:
                mine = common[spelt[q] : spelt[q + 1]][held[spelt[q] : spelt[q + 1]]]
                marked[mine] = True
                flat, begins = _flat(self.spelt, found)
                both = np.add.reduceat(marked[self.spelled[flat]], begins, dtype=np.int64)
                marked[mine] = False
                out["may"] = 2.0 * both / (len(plain[q]) + self.spelt[found + 1] - self.spelt[found]) >= least
            yield q, (ranked(out)[:most] if len(out) > most else out).tobytes(), bool(more)


class Weighted:
    """Texts with their 3- and 2-grams, by gram."""

    def __init__(self, segs: list[str], t: np.ndarray, size: np.ndarray, entries: np.ndarray) -> None:
        self.t, self.size, self.entries = t, size, entries
        text, code = both_rows(segs)
        order = np.argsort(code, kind="stable")
        code, self.texts = code[order], text[order]
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        self.codes, self.of_gram = code[new], np.append(np.flatnonzero(new), len(code))

    def scored(self, codes: np.ndarray, weights: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[int, bytes, bool]]:
        """For each query, its codes and their weights between two places of `at`, the first `most` texts by the sum of shared weights, length and id, and whether there are more."""
        gram = np.searchsorted(self.codes, codes)
        known = gram < len(self.codes)
        known[known] = self.codes[gram[known]] == codes[known]
        lo, hi = self.of_gram[:-1].tolist(), self.of_gram[1:].tolist()
        for q in range(len(at) - 1):
            own = known[at[q] : at[q + 1]]
            g = gram[at[q] : at[q + 1]][own]
            if not len(g):
                continue
            held = np.concatenate([self.texts[lo[x] : hi[x]] for x in g.tolist()])
            score = np.bincount(held, np.repeat(weights[at[q] : at[q + 1]][own], self.of_gram[g + 1] - self.of_gram[g]), len(self.t))
            more = np.count_nonzero(score) > most
            least = np.partition(score, len(score) - most)[len(score) - most] - 2 / PARTS if more else 0.0
            found = np.flatnonzero(score > max(least, 0.0))
            out = np.zeros(len(found), FOUND)
            out["t"], out["n"], out["shared"], out["size"], out["may"] = self.t[found], self.entries[found], np.rint(score[found] * PARTS), self.size[found], True
            yield q, ranked(out)[:most].tobytes(), bool(more)


def ranked(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["t"], rows["first"], rows["size"], -rows["shared"]))]


def merged(parts: list[tuple[bytes, bool]], limit: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """The texts of which all entries are among the query's first `limit`, those of which some are, and how many entries of these.

    None if a block left out texts that could be among them: then they aren't after `limit` texts for certain.
    """
    blocks = [np.frombuffer(data, FOUND) for data, _ in parts]
    rows = ranked(np.concatenate(blocks))
    key = lambda r: (-int(r["shared"]), int(r["size"]), int(r["first"]), int(r["t"]))
    for block, (_, more) in zip(blocks, parts, strict=True):
        if more and (len(rows) < limit or key(ranked(block)[-1]) < key(rows[limit - 1])):
            return None
    new = np.ones(len(rows), bool)
    for name in ("shared", "size", "first"):
        new[1:] &= rows[name][1:] == rows[name][:-1]
    new[1:] = ~new[1:]
    starts = np.flatnonzero(new)
    upto = np.cumsum(np.add.reduceat(rows["n"].astype(np.int64), starts))
    last = int(np.searchsorted(upto, limit))
    if last == len(starts):
        return rows, rows[:0], 0
    a, b = int(starts[last]), int(starts[last + 1]) if last + 1 < len(starts) else len(rows)
    room = limit - int(upto[last - 1] if last else 0)
    if room == int(upto[last] - (upto[last - 1] if last else 0)):
        return rows[:b], rows[:0], 0
    if (rows["n"][a:b] == 1).all():
        return rows[: a + room], rows[:0], 0
    return rows[:a], rows[a:b], room


def count_block(n: int, most: int, least: float = 0.0):
    """For cogrouped queries `q, segs, plain` and texts `t, segs, plain, size, n`: `q, data, more`."""

    def count(queries: pa.Table, texts: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes, bool]] = []
        if queries.num_rows and texts.num_rows:
            plain = [x.column("plain").to_pylist() if least else None for x in (texts, queries)]
            block = Block(texts.column("segs").to_pylist(), texts.column("t").to_numpy(), texts.column("size").to_numpy(), texts.column("n").to_numpy(), n, plain[0])
            ids = queries.column("q").to_pylist()
            rows = [(ids[q], data, more) for q, data, more in block.shared(queries.column("segs").to_pylist(), most, plain[1], least)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.bool_())], ["q", "data", "more"])

    return count


def weighted_block(most: int):
    """For cogrouped queries `q, codes, weights` and texts `t, segs, size, n`: `q, data, more`."""

    def count(queries: pa.Table, texts: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes, bool]] = []
        if queries.num_rows and texts.num_rows:
            block = Weighted(texts.column("segs").to_pylist(), texts.column("t").to_numpy(), texts.column("size").to_numpy(), texts.column("n").to_numpy())
            ids = queries.column("q").to_pylist()
            codes, weights = queries.column("codes").combine_chunks(), queries.column("weights").combine_chunks()
            at = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy())])
            rows = [(ids[q], data, more) for q, data, more in block.scored(codes.flatten().to_numpy(), weights.flatten().to_numpy(), at, most)]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.bool_())], ["q", "data", "more"])

    return count


def code_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts `segs, n` the entries with each gram, `code, df`, once for each code and batch."""
    for b in batches:
        text, code = both_rows(b.column("segs").to_pylist())
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        df = np.add.reduceat(b.column("n").to_numpy()[text[order]], starts) if len(code) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(code[starts]), pa.array(df.astype(np.int64))], ["code", "df"])


def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From `q, segs` the codes of each query's grams: `q, code`."""
    for b in batches:
        text, code = both_rows(b.column("segs").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(text)), pa.array(code)], ["q", "code"])


def run_hashes(texts: list[str], layers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of four characters without a line break of each text as text numbers and hashes with the text's layer."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = max(len(points) - 3, 0)
    text, inside = np.repeat(np.arange(len(texts)), lengths)[:size], np.ones(size, bool)
    code = layers.view(np.uint64)[text]
    for i in range(4):
        part = points[i : i + size]
        code = (code ^ part) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        inside &= part != BREAK
    return text[inside], code[inside]


def support_block(fragments: pa.Table, texts: pa.Table) -> pa.Table:
    """For cogrouped `layer, fragment, own` and texts `own, segs, files` (own: the layer's hash): the texts of the layer that hold each fragment inside a segment, and their files.

    A fragment is looked for in the texts that have the rarest of its runs of four characters.
    """
    out: tuple[list, ...] = ([], [], [])
    if fragments.num_rows and texts.num_rows:
        segs, own = texts.column("segs").to_pylist(), texts.column("own").to_numpy()
        lists = texts.column("files").combine_chunks()
        files, of = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        text, code = run_hashes(segs, own)
        order = np.argsort(code, kind="stable")
        text, code = text[order], code[order]
        wanted, mine = fragments.column("fragment").to_pylist(), fragments.column("own").to_numpy()
        row, asked = run_hashes(wanted, mine)
        lo, hi = np.searchsorted(code, asked), np.searchsorted(code, asked, "right")
        order = np.lexsort((hi - lo, row))
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(row) else order
        for k, a, b in zip(row[first].tolist(), lo[first].tolist(), hi[first].tolist(), strict=True):
            if a == b or "\n" in (x := wanted[k]):
                continue
            held = [t for t in set(text[a:b].tolist()) if x in segs[t] and own[t] == mine[k]]
            if held:
                out[0].append(k)
                out[1].append(len(held))
                out[2].append(np.unique(np.concatenate([files[of[t] : of[t + 1]] for t in held])))
    rows = pa.array(out[0], pa.int64())
    return pa.table([fragments.column("layer").take(rows), fragments.column("fragment").take(rows), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["layer", "fragment", "sources", "files"])


def merge_blocks(limit: int):
    """From `q, data, more`, all rows of a query together: `q, t, n, room, shared`; room is null where all entries count, negative where the query must be asked again.

    Texts that cannot be similar enough are left out once the pool is known.
    """
    names = ["q", "t", "n", "room", "shared"]

    def out(done: list[tuple[int, np.ndarray, int | None]]) -> pa.RecordBatch:
        q = np.repeat(np.array([d[0] for d in done], np.int64), [len(d[1]) for d in done])
        rows = np.concatenate([d[1] for d in done])
        room = np.repeat(np.array([0 if d[2] is None else d[2] for d in done], np.int32), [len(d[1]) for d in done])
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.ascontiguousarray(rows["t"])), pa.array(rows["n"].astype(np.int32)), pa.array(room, mask=room == 0), pa.array(np.ascontiguousarray(rows["shared"]))], names)

    def finish(q: int, parts: list[tuple[bytes, bool]]) -> list[tuple[int, np.ndarray, int | None]]:
        if (m := merged(parts, limit)) is None:
            return [(q, np.zeros(1, FOUND), -1)]
        return [(q, m[0][m[0]["may"]], None), (q, m[1], m[2])]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, done = None, [], []
        for b in batches:
            for q, data, more in zip(b.column("q").to_pylist(), b.column("data").to_pylist(), b.column("more").to_pylist(), strict=True):
                if q != now:
                    if parts:
                        done += finish(now, parts)
                    now, parts = q, []
                parts.append((data, more))
                if len(done) > 400:
                    yield out(done)
                    done = []
        if parts:
            done += finish(now, parts)
        if done:
            yield out(done)

    return merge
