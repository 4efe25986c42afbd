"""Near-duplicates with small edits: an exact set-similarity join by universe partition and pigeonhole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.arrays import ASIDE, added_up, partial_sums
from tandemtext.functions.codepoints import MASK53, fold_batch, mix64, trigrams
from tandemtext.session import durable, sized_join

GRAM = 3
#: Kinds of index entries: to be found, looking for others.
INDEXED, PROBING = 1, 2
#: Bands that are told apart in counts; a set in the last one would have more tokens than memory.
BANDS = 64
#: Bits of a key inside its bucket; keys that agree by chance only cost a comparison of signatures.
KEY_BITS = 26
#: Records in a block of entries; with the kinds, a record's number in it fits in 16 bits.
BLOCK = 4096
#: Keys in a bucket, about; the buckets of a band follow the number of its keys, so that a task's memory is bounded.
BUCKET = 3_000_000


#: A key on more classes than this, and on more than this share of all keys, is hot: its entries are spread over buckets.
HOT, HOT_SHARE = 200_000, 2.0**-16


@dataclass(frozen=True)
class Partition:
    """How token sets are cut into groups of segments.

    threshold: least similarity (Jaccard). ratio: between the largest and the least set size of a band. slack: groups over
    those that the pigeonhole needs, so that each set may leave out its costliest ones. pieces: segments in a group; its
    one-deletion neighbourhood are the subsets with one segment left out. slots: size of the table of key frequencies, which
    only steers the choice of groups and never loses a pair.
    """

    threshold: Fraction = Fraction(7, 10)
    ratio: float = 1.43
    slack: float = 1.05
    pieces: int = 3
    slots: int = 1 << 20

    def differences(self, n: np.ndarray | int, s: np.ndarray | int) -> np.ndarray | int:
        """The most tokens in which sets of these sizes may differ (both ways together) at the threshold."""
        p, q = self.threshold.numerator, self.threshold.denominator
        return ((q - p) * (n + s)) // (q + p)

    def least_partner(self, n: np.ndarray) -> np.ndarray:
        """The least size of a set that can reach the threshold with one of size n."""
        p, q = self.threshold.numerator, self.threshold.denominator
        return -(-p * n // q)

    def bands(self, largest: int) -> np.ndarray:
        """The largest size of each band."""
        out = [1]
        while out[-1] < largest:
            lo = out[-1] + 1
            out.append(max(lo, int(lo * self.ratio)))
        return np.array(out, np.int64)

    def words(self, band: int, largest: int = 1 << 40) -> int:
        """64-bit words of the signatures compared in a band: enough bits to tell unlike sets of its size apart."""
        return int(1.6 * self.bands(largest)[band] // 64) + 1

    def groups(self, hi: np.ndarray) -> np.ndarray:
        """The number of groups of each band: enough for the largest set that looks for partners in it."""
        p, q = self.threshold.numerator, self.threshold.denominator
        return np.ceil(self.slack * (self.differences(hi, hi * q // p) + 1) / 2).astype(np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting is faster here than the hash table of np.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def token_sets(sources: list[str], targets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each record's distinct tokens as 53-bit hashes, sorted by record, and the record of each."""
    n = len(sources)
    hashes, owners = [], []
    for texts in (sources, targets):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, n))])
        grams, owner = trigrams(points, offsets)
        hashes.append(mix64(grams) & MASK53)
        owners.append(owner)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    out_h, out_o = [], []
    for a in range(0, n, 2048):  # 11 bits for the record, 53 for the hash
        mine = (o >= a) & (o < a + 2048)
        both = distinct(((o[mine] - a).astype(np.uint64) << np.uint64(53)) | h[mine])
        out_h.append(both & MASK53)
        out_o.append((both >> np.uint64(53)).astype(np.int64) + a)
    return (np.concatenate(out_h), np.concatenate(out_o)) if out_h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def signatures(h: np.ndarray, owner: np.ndarray, n: int, words: int) -> np.ndarray:
    """The parity signature of each of n records' token sets, one row a record.

    A bit is the parity of the tokens that fall on it. Sets that differ in d tokens have signatures that differ in at most d
    bits, so a pair with more is none; nothing else is left out by it.
    """
    bit = (mix64(h ^ np.uint64(0xA5A5A5A5)) >> np.uint64(20)) % np.uint64(64 * words)
    odd = (np.bincount(owner * (64 * words) + bit.astype(np.int64), minlength=n * 64 * words) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, -1), axis=1).view(np.uint64)


def group_keys(h: np.ndarray, owner: np.ndarray, chosen: np.ndarray, band: np.ndarray, part: Partition, his: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the chosen records' groups, each record's number of groups, and the record of each group.

    keys: one row a group; in column 0 the whole group's key, then those with the first, second... segment left out. They come
    from sums of the tokens' weights, so that leaving out a segment is a subtraction.
    """
    m = np.where(chosen, part.groups(his)[band], 0)
    at = np.concatenate([[0], np.cumsum(m)])
    mine = chosen[owner]
    h, owner = h[mine], owner[mine]
    segment = (h % np.maximum(m[owner] * part.pieces, 1).astype(np.uint64)).astype(np.int64)
    weight = (mix64(h) >> np.uint64(32)).astype(np.float64)  # sums of 32-bit numbers are exact
    sums = np.bincount(at[owner] * part.pieces + segment, weights=weight, minlength=int(at[-1]) * part.pieces).astype(np.uint64).reshape(-1, part.pieces)
    whole = sums.sum(axis=1, dtype=np.uint64)[:, None]
    of = np.repeat(np.arange(len(m)), m)
    group = np.arange(len(of)) - at[of]
    salt = (band[of].astype(np.uint64) << np.uint64(40)) | (group.astype(np.uint64) << np.uint64(8))
    left_out = np.arange(part.pieces + 1, dtype=np.uint64)[None, :]
    return mix64(mix64(np.concatenate([whole, whole - sums], axis=1)) ^ (salt[:, None] | left_out)), m, of


def allocated(keys: np.ndarray, m: np.ndarray, of: np.ndarray, need: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Which keys each record looks for: the cheapest choice of groups that adds up to its need.

    A group that must be equal counts 1, one that may differ in a segment 2; the costs are the frequencies of the keys.
    """
    cost = frequency[keys & np.uint64(len(frequency) - 1)].astype(np.int64)
    equal, loose = cost[:, 0], cost[:, 1:].sum(axis=1)
    n = len(of)
    item = np.concatenate([equal, np.maximum(loose - equal, equal)])
    owner = np.concatenate([of, of])
    order = np.argsort((owner << 40) + (np.minimum(item, (1 << 38) - 1) << 1) + (np.arange(2 * n) >= n), kind="stable")
    begin = np.cumsum(2 * m) - 2 * m
    taken = order[np.arange(2 * n) - begin[owner[order]] < need[owner[order]]]
    out = np.zeros(keys.shape, bool)
    out[taken[taken < n], 0] = True
    two = taken[taken >= n] - n
    out[two, 0] = False
    out[two, 1:] = True
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Record ids, token hashes, their records and set sizes, at most BLOCK records at a time."""
    for b in batches:
        for a in range(0, b.num_rows, BLOCK):
            part = b.slice(a, BLOCK)
            h, owner = token_sets(part.column("s").to_pylist(), part.column("t").to_pylist())
            yield part.column("cid").to_numpy(), h, owner, np.bincount(owner, minlength=part.num_rows)


def _entries(part: Partition, frequency: np.ndarray, counts: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the index and probe entries of each block by bucket: keys (32 bits), record and kind (16 bits), and what is needed of the records."""
    in_band = np.where(counts > 0, np.maximum(1, -(-counts // BUCKET)), 1)  # buckets of each band
    base = np.concatenate([[0], np.cumsum(in_band)])
    band_of = np.repeat(np.arange(BANDS), in_band)
    width = [part.words(b) if counts[b] else 1 for b in range(BANDS)]
    hot_keys, hot_spread = hot  # sorted, and over how many buckets each is spread

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, (cid, h, owner, size) in enumerate(_blocks(batches)):
            his = part.bands(int(size.max(initial=1)))
            band = np.searchsorted(his, size)
            key, kind, local, level = [], [], [], []
            for below in range(len(his)):  # partners that are not larger stand in the own band or a few below
                lower = np.maximum(band - below, 0)
                chosen = (band >= below) & (part.least_partner(size) <= his[lower])
                if not chosen.any():
                    break
                keys, m, of = group_keys(h, owner, chosen, lower, part, his)
                probing = allocated(keys, m, of, part.differences(size, np.minimum(size, his[lower])) + 1, frequency)
                wanted = np.ones(keys.shape, bool) if below == 0 else probing
                key.append(keys[wanted])
                kind.append((INDEXED if below == 0 else 0) | np.where(probing[wanted], PROBING, 0))
                local.append(np.broadcast_to(of[:, None], keys.shape)[wanted])
                level.append(lower[local[-1]])
            key, kind, local, level = np.concatenate(key), np.concatenate(kind), np.concatenate(local), np.concatenate(level)
            spread = np.ones(len(key), np.int64)
            if len(hot_keys):
                place = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                spread = np.where(hot_keys[place] == key, hot_spread[place], 1)
            salt = np.where(spread > 1, (no * 7919 + int(cid[0])) % spread, 0)
            if (spread > 1).any():  # probes go to every bucket of a hot key, index entries to one
                again = np.nonzero((spread > 1) & (kind & PROBING > 0))[0]
                times = spread[again] - 1
                rep = np.repeat(again, times)
                step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + 1
                key, local, level = np.concatenate([key, key[rep]]), np.concatenate([local, local[rep]]), np.concatenate([level, level[rep]])
                salt = np.concatenate([salt, (salt[rep] + step) % spread[rep]])
                kind = np.concatenate([kind, kind[rep] & ~INDEXED])
            inside = mix64((key >> np.uint64(32)) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % in_band[level].astype(np.uint64)
            bucket = base[level] + inside.astype(np.int64)
            order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | (key & np.uint64((1 << KEY_BITS) - 1)))
            about = np.stack([cid.view(np.uint64), size.astype(np.uint64)], axis=1)
            signed: dict[int, np.ndarray] = {}
            pack = zstandard.ZstdCompressor(level=1).compress
            bounds = np.searchsorted(bucket[order], np.arange(base[-1] + 1))
            out: tuple[list, ...] = ([], [], [], [], [])
            for k in np.nonzero(np.diff(bounds))[0]:
                here = order[bounds[k] : bounds[k + 1]]
                used, inverse = np.unique(local[here], return_inverse=True)
                low = (key[here] & np.uint64((1 << KEY_BITS) - 1)).astype(np.uint32)
                gaps = np.diff(low, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4)  # sorted: the high bytes are mostly 0
                out[0].append(int(k))
                out[1].append(pack(np.ascontiguousarray(gaps.T).tobytes()))
                both = ((inverse << 2) | kind[here]).astype(np.uint16).view(np.uint8).reshape(-1, 2)
                out[2].append(pack(np.ascontiguousarray(both.T).tobytes()))
                words = width[band_of[k]]
                if words not in signed:
                    signed[words] = signatures(h, owner, len(cid), words)
                out[3].append(np.concatenate([about[used], signed[words][used]], axis=1).tobytes())
                out[4].append(words)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.binary()) for x in out[1:4]], pa.array(out[4], pa.int32())], ["bucket", "keys", "kinds", "records", "words"])

    return scan


def often(keys: np.ndarray) -> bytes:
    """The keys that make at least HOT_SHARE of a block's keys, with their numbers: what is hot among all is so in some block."""
    x = np.sort(keys.ravel())
    first = np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0] if len(x) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(x)))
    many = times >= max(2, HOT_SHARE * len(x))
    return np.stack([x[first][many], times[many].astype(np.uint64)]).tobytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column("data").to_pylist():
            key, n = np.frombuffer(data, np.uint64).reshape(2, -1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])


def hot_keys(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The hot keys, sorted, and over how many buckets each is spread; no more than 1 / HOT_SHARE keys, whatever the data."""
    least = max(HOT, HOT_SHARE * total)
    counted = rows.where(f"block = {ASIDE}").select("data").mapInArrow(_unpacked, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = sorted((r["key"] & (1 << 64) - 1, -(-r["n"] // HOT)) for r in counted.collect())
    return np.array([k for k, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def _meet(part: Partition) -> Callable[[pa.Table], pa.Table]:
    """Pairs of records in one bucket: one looks for a key that the other has, and their signatures and sizes allow the threshold."""

    def meet(entries: pa.Table) -> pa.Table:
        keys, kinds, about = [], [], []
        base, unpack = 0, zstandard.ZstdDecompressor().decompress
        words = entries["words"][0].as_py()
        for k, x, i in zip(entries["keys"].to_pylist(), entries["kinds"].to_pylist(), entries["records"].to_pylist(), strict=True):
            gaps = np.ascontiguousarray(np.frombuffer(unpack(k), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            packed = np.ascontiguousarray(np.frombuffer(unpack(x), np.uint8).reshape(2, -1).T).view(np.uint16).ravel()
            keys.append(np.cumsum(gaps, dtype=np.uint32))
            about.append(np.frombuffer(i, np.uint64).reshape(-1, 2 + words))
            kinds.append(((packed >> 2).astype(np.int64) + base) * 4 + (packed & 3))
            base += len(about[-1])
        key, kind, record = np.concatenate(keys), np.concatenate(kinds), np.concatenate(about)
        cid, size, signature = record[:, 0].view(np.int64), record[:, 1].astype(np.int64), np.ascontiguousarray(record[:, 2:])
        del keys, kinds, about, record
        order = np.argsort(key, kind="stable")
        key, kind = key[order], kind[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.nonzero(new)[0]
        run = np.cumsum(new) - 1
        length = np.diff(np.concatenate([start, [len(key)]]))
        probes = np.nonzero((kind & PROBING > 0) & (length[run] > 1))[0]
        pairs = [np.zeros(0, np.int64)]
        width = length[run[probes]]
        ends = np.cumsum(width)
        a = 0
        while a < len(probes):  # so many probes at a time that a million meetings are in memory
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 1_000_000)))
            w = width[a:z]
            x = np.repeat(probes[a:z], w)
            y = np.repeat(start[run[probes[a:z]]], w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            p, q = kind[x], kind[y]
            met = (q & INDEXED > 0) & (p >> 2 != q >> 2)
            p, q = p[met] >> 2, q[met] >> 2
            small, large = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
            fit = part.least_partner(large) <= small
            p, q, limit = p[fit], q[fit], part.differences(small[fit], large[fit])
            fit = np.bitwise_count(signature[p] ^ signature[q]).sum(axis=1) <= limit
            pairs.append(distinct(np.minimum(p[fit], q[fit]) * base + np.maximum(p[fit], q[fit])))
            a = z
        both = distinct(np.concatenate(pairs))
        one, two = cid[both // max(base, 1)], cid[both % max(base, 1)]
        apart = one != two
        return pa.table({"a": np.minimum(one, two)[apart], "b": np.maximum(one, two)[apart]})

    return meet


def _similar(threshold: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verifies pairs by their exact token sets."""

    def tokens(s: str, t: str) -> set[str]:
        return {x[i : i + GRAM] for x in (s, t) for i in range(len(x) - GRAM + 1)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_b = None, set()
        for batch in batches:
            a, b, s, t, u, v = (batch.column(c).to_pylist() for c in ("a", "b", "s", "t", "u", "v"))
            keep = []
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, set_b = b[i], tokens(u[i], v[i])
                set_a = tokens(s[i], t[i])
                common = len(set_a & set_b)
                if common * threshold.denominator >= threshold.numerator * (len(set_a) + len(set_b) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b)], ["a", "b"])

    return scan


def _class_keys(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, at = fold_batch(b.column("s").to_pylist())
            t, to = fold_batch(b.column("t").to_pylist())
            rows = np.nonzero(np.diff(at) >= least)[0]
            k = np.empty((len(rows), 2), np.int64)
            for j, i in enumerate(rows):
                x = xxhash.xxh3_128(s[at[i] : at[i + 1]])
                x.update(b"\xff\xff\xff\xff")
                x.update(t[to[i] : to[i + 1]])
                k[j] = np.frombuffer(x.digest(), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array(k[:, 0]), pa.array(k[:, 1])], ["id", "k1", "k2"])

    return scan


def _folded_rows(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The folded fields of the records that _class_keys() gives a key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, rows = [], None
            for c in ("s", "t"):
                points, at = fold_batch(b.column(c).to_pylist())
                rows = np.nonzero(np.diff(at) >= least)[0] if rows is None else rows
                whole = points.tobytes().decode("utf-32-le", "surrogatepass")
                columns.append(pa.array([whole[at[i] : at[i + 1]] for i in rows], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), *columns], ["cid", "s", "t"])

    return scan


def near_duplicate_classes(df: DataFrame, id_col: str, first: str, second: str, least: int = 45, part: Partition | None = None) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of distinct folded records, and the records of each: DataFrames `a, b` and `cid, id`.

    Records equal after folding form one class, named by its smallest id. A class's set holds the distinct runs of three code
    points of its two folded fields. The tokens are hashed into segments, their number given by the band of the set's size,
    so that two sets at the threshold must agree in some allocated group of segments, or differ there in one segment where the
    allocation counts that group twice. Each class allocates its cheapest segments by the frequencies of all keys, counted over all
    classes in a table of fixed size. Entries are packed by key into buckets of bounded size; hot keys, counted key by
    key, are spread over several. Candidates are verified by their exact sets, so the result is exact: nothing is capped.

    Nulls count as empty. Records whose first field has fewer than `least` folded code points, or with a null id, are left
    out. Repeated records are in one class. Other columns are ignored. Empty tables give no rows.
    """
    part = part or Partition()
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(first).alias("s"), F.col(second).alias("t")).where("id is not null")
    long = raw.where((F.length("s") >= least) | F.col("s").contains("İ"))  # only that letter's lower case is longer
    keyed = durable(long.mapInArrow(_class_keys(least), "id bigint, k1 bigint, k2 bigint"), "near-keys")
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("cid"))
    members = durable(keyed.join(classes, ["k1", "k2"]).select("cid", "id"), "near-members")
    copies = members.where("cid <> id").select("id")
    texts = durable(sized_join(long, copies, "id", "left_anti").mapInArrow(_folded_rows(least), "cid bigint, s string, t string"), "near-texts")

    def count(total: np.ndarray, batch: pa.RecordBatch) -> bytes:
        every = []
        for cid, h, owner, size in _blocks(iter([batch])):
            his = part.bands(int(size.max(initial=1)))
            band = np.searchsorted(his, size)
            keys, _, of = group_keys(h, owner, np.ones(len(cid), bool), band, part, his)
            total[: part.slots] += np.bincount((keys.ravel() & np.uint64(part.slots - 1)).astype(np.int64), minlength=part.slots)
            total[part.slots :] += np.bincount(band[of], minlength=BANDS) * keys.shape[1]
            every.append(keys.ravel())
        return often(np.concatenate(every))

    start = lambda: np.zeros(part.slots + BANDS, np.int64)
    rows = durable(partial_sums(texts, start, count), "near-counts")
    total = added_up(rows, start)
    frequency, counts = total[: part.slots], total[part.slots :]
    hot = hot_keys(rows, int(counts.sum()))
    frequency = np.minimum(frequency, 2**31 - 1).astype(np.int32) if frequency.max(initial=0) < 2**31 else frequency
    shared = df.sparkSession.sparkContext.broadcast((frequency, hot))  # tables of fixed size: slots * 4 bytes, 65,536 keys at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _entries(part, shared.value[0], counts, shared.value[1])(batches)

    entries = texts.mapInArrow(emit, "bucket int, keys binary, kinds binary, records binary, words int")
    candidates = durable(entries.groupBy("bucket").applyInArrow(_meet(part), "a bigint, b bigint").distinct(), "near-candidates")
    texts = sized_join(texts, durable(candidates.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "near-chosen"), "cid", "left_semi")
    whole = candidates.join(texts.withColumnRenamed("cid", "a"), "a").join(texts.select(F.col("cid").alias("b"), F.col("s").alias("u"), F.col("t").alias("v")), "b")
    return durable(whole.mapInArrow(_similar(part.threshold), "a bigint, b bigint"), "near-pairs"), members


def near_duplicate_pairs(df: DataFrame, id_col: str, first: str, second: str, least: int = 45, part: Partition | None = None) -> DataFrame:
    """Pairs `id_a < id_b` of similar records whose folded fields differ; edge cases as in near_duplicate_classes()."""
    pairs, members = near_duplicate_classes(df, id_col, first, second, least, part)
    left, right = members.select(F.col("cid").alias("a"), F.col("id").alias("x")), members.select(F.col("cid").alias("b"), F.col("id").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_links(df: DataFrame, id_col: str, first: str, second: str, least: int = 45, part: Partition | None = None) -> DataFrame:
    """Each record with its class and the number of other classes it is similar to: `id, cid, links`."""
    pairs, members = near_duplicate_classes(df, id_col, first, second, least, part)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    return members.join(degree, "cid", "left").select("id", "cid", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
