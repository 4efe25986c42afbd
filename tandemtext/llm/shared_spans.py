"""Long exact spans shared between records: a log-structured fingerprint index with verification against the texts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions.codepoints import codepoints, mix64, slices
from tandemtext.functions.folding import TAG, hash128
from tandemtext.session import durable, remove, shared_dir, shuffle_partitions, sized_join

#: A span's least length, and the length of the runs whose hashes stand for the windows of that length.
SPAN, ANCHOR = 40, 16
#: Records of one batch that make a hash hot.
HOT = 32


def stretches(text: str, least: int) -> list[tuple[int, str]]:
    """The parts between tag markers with at least so many code points, each with its place in the text."""
    if "<tag" not in text:
        return [(0, text)] if len(text) >= least else []
    out, at = [], 0
    for m in TAG.finditer(text):
        if m.start() - at >= least:
            out.append((at, text[at : m.start()]))
        at = m.end()
    if len(text) - at >= least:
        out.append((at, text[at:]))
    return out


class Windows:
    """All windows of `span` code points in the stretches of a batch of texts, vectorised.

    of: the text of each window; start: its first code point in that text, from 0; anchor: the hash of the least run of
    `anchor` code points inside it (the leftmost of equal ones), which depends on nothing but the window; place: where that
    run stands in the batch. Equal windows have equal anchors.
    """

    def __init__(self, texts: list[str | None], span: int, anchor: int) -> None:
        cut = [(i, at, s) for i, t in enumerate(texts) if t is not None and len(t) >= span for at, s in stretches(t, span)]
        points, offsets = codepoints([s for _, _, s in cut])
        self.span, self.points = span, points
        length = np.diff(offsets)
        windows = length - span + 1
        total = int(windows.sum())
        which = np.repeat(np.arange(len(cut)), windows)
        first = np.cumsum(windows) - windows
        inside = np.arange(total) - first[which]
        self.at = offsets[:-1][which] + inside
        self.of = np.array([i for i, _, _ in cut], np.int64)[which] if cut else np.zeros(0, np.int64)
        self.start = (np.array([at for _, at, _ in cut], np.int64)[which] if cut else np.zeros(0, np.int64)) + inside
        if not total:
            self.anchor, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        self.runs = hashed_runs(points, anchor, 1)
        bits = max(1, int(len(points)).bit_length())
        order = ((self.runs >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(self.runs), dtype=np.uint64)
        least = sliding_min(order, span - anchor + 1)
        self.place = (least[self.at] & np.uint64((1 << bits) - 1)).astype(np.int64)
        self.anchor = self.runs[self.place].view(np.int64)

    def fingerprints(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each whole window, independent of the anchors and of other seeds."""
        return hashed_runs(self.points, self.span, seed)[self.at].view(np.int64) if len(self.at) else np.zeros(0, np.int64)


def hashed_runs(points: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of the `length` code points from each place on, put together from runs of 1, 2, 4, 8... code points."""
    h, have, out, done = mix64(points.astype(np.uint64) + np.uint64(seed * 0x9E3779B9)), 1, None, 0
    while True:
        if length & have:
            if out is None:
                out = h.copy()
            else:
                tail = h[done:]
                out = mix64(out[: len(tail)] * np.uint64(0x9E3779B97F4A7C15) + tail)
            done += have
        if done == length:
            return out[: max(0, len(points) - length + 1)]
        if len(h) <= have:
            return np.zeros(0, np.uint64)
        h = mix64(h[:-have] * np.uint64(0xD1B54A32D192ED03) + h[have:] + np.uint64(have))
        have *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each place on."""
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _postings(span: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The anchors of each record, once each; `hot` marks those that HOT records of a batch have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for x, y in slices(texts):
                w = Windows(texts[x:y], span, anchor)
                new = np.ones(len(w.place), bool)
                new[1:] = w.place[1:] != w.place[:-1]
                h, of = w.anchor[new], w.of[new]
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, of = h[once], of[once]
                first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[x:y][of]), pa.array(np.repeat(times >= HOT, times))], ["h", "rid", "hot"])

    return scan


class FingerprintIndex:
    """A log-structured index: sorted immutable runs of the anchor hashes of all windows seen so far, each with its record.

    A run is a table `h, rid` in hash buckets of h, sorted within each, written once. append() stores a batch of records (their
    texts and a run of level 0) and gives the hashes that meet: the new run is merge-joined bucket by bucket with every
    earlier run, which Spark does without shuffling or sorting either side. compact() merges the runs of a level that has
    `fanout` of them into one of the next level, again bucket by bucket, and deletes the merged ones.

    Hashes that many records of one batch share are kept apart in a run (`hot`), spread over tasks by record, so that a text or
    a phrase on a third of all rows is no bucket of its own. The manifest names the runs, texts and spans that count and is
    written last, so a job that dies leaves the former state. open() goes on with the newest manifest in the folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, span: int = SPAN, anchor: int = ANCHOR, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.span, self.anchor, self.fanout = spark, span, anchor, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.path = path or f"{shared_dir(spark)}/tandemtext/fingerprints-{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []
        self.texts_of: list[str] = []
        self.spans_of: list[str] = []
        self.version = 0
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one sorted file

    @classmethod
    def open(cls, spark: SparkSession, path: str, **kind: int) -> FingerprintIndex:
        index = cls(spark, path, **kind)
        names = spark.read.text(f"{path}/manifest-*").select("value", F.regexp_extract(F.col("_metadata.file_path"), r"manifest-(\d+)", 1).cast("int").alias("v"))
        newest = names.orderBy(F.desc("v")).first()
        state = json.loads(newest["value"])
        if (index.span, index.anchor) != (state["span"], state["anchor"]):
            raise ValueError(f"the index was made for spans of {state['span']} and anchors of {state['anchor']}")
        index.version, index.buckets, index.texts_of, index.spans_of = newest["v"], state["buckets"], state["texts"], state["spans"]
        index.runs = [tuple(x) for x in state["runs"]]
        return index

    def _commit(self) -> None:
        self.version += 1
        state = {"runs": self.runs, "texts": self.texts_of, "spans": self.spans_of, "buckets": self.buckets, "span": self.span, "anchor": self.anchor}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:06d}")

    def _write(self, postings: DataFrame, spread: bool) -> str:
        """A run; where the postings already are in their buckets they stay there."""
        name = f"run_{uuid.uuid4().hex}"
        if spread:
            apart = F.xxhash64("h", F.pmod(F.xxhash64("rid"), F.lit(64)))
            postings = postings.repartition(self.buckets, F.when(F.col("hot"), apart).otherwise(F.col("h")))
        writer = postings.select("h", "rid", "hot").write.partitionBy("hot").bucketBy(self.buckets, "h").sortBy("h", "rid")
        writer.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _run(self, name: str, hot: bool) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (h BIGINT, rid BIGINT, hot BOOLEAN) USING parquet PARTITIONED BY (hot) CLUSTERED BY (h) SORTED BY (h, rid) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(name).where(F.col("hot") if hot else ~F.col("hot")).select("h", "rid")

    def _meeting(self, fresh: str) -> DataFrame:
        """The hashes of a new run that two records have, one of them in it."""
        main, hot = self._run(fresh, False), self._run(fresh, True)
        many = durable(hot.select("h").distinct(), "hot-hashes")
        parts = [main.groupBy("h").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a <> b").select("h"), many]
        for _, name in self.runs:
            earlier = self._run(name, False)
            parts.append(earlier.join(main.select("h").hint("merge"), "h", "left_semi").select("h").distinct())
            old = durable(self._run(name, True).select("h").distinct(), "hot-hashes")
            parts.append(sized_join(main.select("h"), old, "h", "left_semi").distinct())
        return durable(reduce(DataFrame.unionByName, parts).distinct(), "meeting-hashes")

    def append(self, records: DataFrame) -> DataFrame:
        """Adds the records `rid, text`; gives `h, rid` of all records, earlier ones too, with a hash that one of the new ones shares."""
        texts = f"texts-{uuid.uuid4().hex}"
        records.select("rid", "text").write.option("compression", "zstd").parquet(f"{self.path}/{texts}")
        stored = self.spark.read.schema("rid bigint, text string").parquet(f"{self.path}/{texts}")
        fresh = self._write(stored.mapInArrow(_postings(self.span, self.anchor), "h bigint, rid bigint, hot boolean"), True)
        shared = self._meeting(fresh)
        names = [fresh, *[name for _, name in self.runs]]
        met = durable(reduce(DataFrame.unionByName, [sized_join(self._run(name, hot), shared, "h", "left_semi") for name in names for hot in (False, True)]), "meeting-records")
        self.runs, self.texts_of = [*self.runs, (0, fresh)], [*self.texts_of, texts]
        self._commit()
        self.compact()
        return met

    def compact(self) -> None:
        level = 0
        while any(x == level for x, _ in self.runs):
            full = [name for x, name in self.runs if x == level]
            if len(full) >= self.fanout:
                # grouping within the buckets keeps them: no shuffle, and each task writes its bucket as one sorted file
                main = reduce(DataFrame.unionByName, [self._run(name, False) for name in full]).groupBy("h", "rid").agg(F.lit(False).alias("hot"))
                merged = self._write(main, False)
                hot = reduce(DataFrame.unionByName, [self._run(name, True) for name in full]).withColumn("hot", F.lit(True))
                if not hot.isEmpty():
                    apart = F.xxhash64("h", F.pmod(F.xxhash64("rid"), F.lit(64)))
                    hot.repartition(self.buckets, apart).write.insertInto(merged)
                self.runs = [*[r for r in self.runs if r[0] != level], (level + 1, merged)]
                self._commit()
                for name in full:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                    remove(self.spark, f"{self.path}/{name}")
            level += 1

    def postings(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._run(name, hot) for _, name in self.runs for hot in (False, True)])

    def texts(self) -> DataFrame:
        """The records of all batches."""
        return self.spark.read.schema("rid bigint, text string").parquet(*[f"{self.path}/{name}" for name in self.texts_of])

    def add_spans(self, spans: DataFrame) -> DataFrame:
        """Stores spans `rid, start, stop` found for a batch; gives them as they are stored."""
        name = f"spans-{uuid.uuid4().hex}"
        spans.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.spans_of = [*self.spans_of, name]
        self._commit()
        return self.spark.read.schema(spans.schema).parquet(f"{self.path}/{name}")

    def spans(self) -> DataFrame:
        """The spans of all records, as far as the batches so far show them: `rid, span_start, span_len`."""
        if not self.spans_of:
            return self.spark.createDataFrame([], "rid bigint, span_start bigint, span_len bigint")
        found = self.spark.read.schema("rid bigint, start int, stop int").parquet(*[f"{self.path}/{name}" for name in self.spans_of])
        return _rows(_joined(found))


def _grouped(w: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by window hash and record: where each hash begins, and a partner of each row among the others with its hash (itself: none)."""
    if not len(w):
        return np.zeros(0, np.int64), rid
    first = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0]
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
    least, most = rid[first], rid[np.append(first[1:], len(w)) - 1]
    return first, np.where(rid == least[group], most[group], least[group])


def _window_rows(span: int, anchor: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows whose anchor is among the record's hashes `hs`, with a hash of the whole window and, where the batch has one, a partner.

    Of the rows of a hash that have a partner in the batch only one goes on to look for others, so a window on a third of all
    records is a row a batch in the exchange by hash.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, hs = b.column("text").to_pylist(), b.column("rid").to_numpy(), b.column("hs")
            for x, y in slices(texts):
                windows = Windows(texts[x:y], span, anchor)
                part = hs.slice(x, y - x)
                row = np.repeat(np.arange(y - x), pc.list_value_length(part).to_numpy())
                known = mix64(part.flatten().to_numpy().view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                mine = mix64(windows.anchor.view(np.uint64) + windows.of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keep = np.isin(mine, known)
                w, rid, start = windows.fingerprints(seed)[keep], ids[x:y][windows.of[keep]], windows.start[keep].astype(np.int32)
                order = np.lexsort((rid, w))
                w, rid, start = w[order], rid[order], start[order]
                first, partner = _grouped(w, rid)
                met = partner != rid
                again = first[met[first]]
                none = np.concatenate([~met, np.ones(len(again), bool)])
                w, rid, start, partner = (np.concatenate([c, c[again]]) for c in (w, rid, start, partner))
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(rid), pa.array(start), pa.array(partner, mask=none)], ["w", "rid", "start", "partner"])

    return scan


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partner for each window of rows sorted by hash and record; rows that have one already pass."""

    def rows(rid: np.ndarray, start: np.ndarray, partner: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start), pa.array(partner)], ["rid", "start", "partner"])

    rest = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    for b in batches:
        done = b.filter(pc.is_valid(b.column("partner")))
        if done.num_rows:
            yield rows(*(done.column(c).to_numpy() for c in ("rid", "start", "partner")))
        left = b.filter(pc.is_null(b.column("partner")))
        w, rid, start = (np.concatenate([old, left.column(c).to_numpy()]) for old, c in zip(rest, ("w", "rid", "start"), strict=True))
        first, partner = _grouped(w, rid)
        upto = int(first[-1]) if len(first) else 0
        rest = w[upto:], rid[upto:], start[upto:]
        met = np.nonzero(partner[:upto] != rid[:upto])[0]
        yield rows(rid[met], start[met], partner[met])
    w, rid, start = rest
    partner = _grouped(w, rid)[1]
    met = partner != rid
    yield rows(rid[met], start[met], partner[met])


def _verified(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Checks, for each record and partner, that the windows stand in a stretch of the partner's text; gives runs of windows, `held` or not."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, bool]] = []
            for r, starts, text, other in zip(b.column("rid").to_pylist(), b.column("starts"), b.column("text").to_pylist(), b.column("other").to_pylist(), strict=True):
                s = np.sort(starts.values.to_numpy())
                parts = [p for _, p in stretches(other, span)]
                for run in np.split(s, np.nonzero(np.diff(s) != 1)[0] + 1):
                    a, z = int(run[0]), int(run[-1]) + span
                    if any(text[a:z] in p for p in parts):
                        out.append((r, a, z, True))
                    else:
                        out += [(r, int(x), int(x) + span, any(text[x : x + span] in p for p in parts)) for x in run]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["rid", "start", "stop", "held"])

    return scan


def shared_spans(records: list[DataFrame], span: int = SPAN, anchor: int = ANCHOR, index: FingerprintIndex | None = None) -> DataFrame:
    """For records (DataFrames `rid, text`, one per batch) which stretches also stand, unchanged, in another record.

    Each batch is appended to the fingerprint index, which merge-joins its hashes with those of all earlier batches. Records with
    a hash that meets, usually few, are the candidates; of their windows only those with such a hash are compared by a hash of
    the whole window. Each window gets a partner record and is verified against its text, with a second hash where the first
    gave a wrong one; verified windows are joined to maximal runs of shared characters. Of candidates with one and the same text (128-bit hash) only the first takes
    part in this; all of them share every long stretch.

    An index that already holds records goes on. Returned are the spans of this call's records and of earlier records that share
    something with them, the latter with what was found before; index.spans() gives those of all records. Batches
    in one call, in many calls, or with the index opened anew in between, give the same spans.

    Returns `rid, span_start, span_len`: code points, span_start from 1. No sampling: every window of every record takes part
    (equal windows have equal anchors). Joins on hashes or partners can be split by adaptive execution; the hashes of a hot
    text are spread by record in the runs.

    Tag markers split a text into stretches that no span crosses. Null, empty and short texts have no span. A text that
    repeats a span only within itself shares nothing. rid must be unique over all batches; rows with a null rid are left out.
    Other columns are ignored. Empty tables give no rows.
    """
    spark = records[0].sparkSession
    index = index or FingerprintIndex(spark, span=span, anchor=anchor)
    before = list(index.spans_of)
    met = [index.append(r.select(F.col("rid").cast("bigint").alias("rid"), "text").where(F.col("rid").isNotNull() & (F.length("text") >= span))) for r in records]
    candidates = reduce(DataFrame.unionByName, met).groupBy("rid").agg(F.collect_set("h").alias("hs"))
    t1, t2 = hash128(F.col("text"))
    chosen = durable(index.texts().join(candidates, "rid").select("rid", "text", "hs", t1.alias("t1"), t2.alias("t2")), "span-candidates")
    members = durable(
        chosen.select("rid", "t1", "t2").join(chosen.groupBy("t1", "t2").agg(F.min("rid").alias("rep"), (F.count("*") > 1).alias("copied")), ["t1", "t2"]).select("rid", "rep", "copied"),
        "span-copies",
    )
    reps = sized_join(chosen.drop("t1", "t2"), members.where("rid <> rep").select("rid"), "rid", "left_anti")
    copied = durable(members.where("copied and rid = rep").select("rid"), "span-copied")
    texts = chosen.select("rid", "text")

    def verified(seed: int, only: DataFrame | None = None) -> DataFrame:
        windows = reps.mapInArrow(_window_rows(span, anchor, seed), "w bigint, rid bigint, start int, partner bigint")
        met = windows.repartition(F.when(F.col("partner").isNull(), F.col("w")).otherwise(F.col("rid"))).sortWithinPartitions("w", "rid")
        partners = sized_join(met.mapInArrow(_partners, "rid bigint, start int, partner bigint"), copied, "rid", "left_anti")
        if only is not None:
            partners = partners.join(only, ["rid", "start"], "left_semi")
        runs = partners.groupBy("rid", "partner").agg(F.collect_set("start").alias("starts"))
        checked = runs.join(texts, "rid").join(texts.select(F.col("rid").alias("partner"), F.col("text").alias("other")), "partner")
        return durable(checked.select("rid", "starts", "text", "other").mapInArrow(_verified(span), "rid bigint, start int, stop int, held boolean"), "span-verified")

    spans = verified(2)
    failed = spans.where("not held").select("rid", "start").distinct()
    if not failed.isEmpty():  # another window with the same hash was the partner: another hash decides, 128 bits in all
        spans = spans.where("held").unionByName(verified(3, failed).where("held"))
    spans = spans.select("rid", "start", "stop")
    whole = sized_join(texts, copied, "rid", "left_semi").mapInArrow(_whole(span), "rid bigint, start int, stop int")
    merged = _joined(spans).unionByName(whole)
    each = index.add_spans(merged.withColumnRenamed("rid", "rep").join(members.select("rid", "rep"), "rep").select("rid", "start", "stop"))
    if not before:
        return _rows(each)
    earlier = spark.read.schema(each.schema).parquet(*[f"{index.path}/{name}" for name in before])
    return _rows(_joined(each.unionByName(earlier.join(each.select("rid").distinct(), "rid", "left_semi"))))


def _joined(spans: DataFrame) -> DataFrame:
    """The spans `rid, start, stop` of each record, overlapping and adjoining ones as one."""
    per = spans.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return per.select("rid", F.explode(_merged("spans")).alias("m")).select("rid", "m.start", "m.stop")


def _rows(spans: DataFrame) -> DataFrame:
    return spans.select("rid", (F.col("start") + 1).cast("bigint").alias("span_start"), (F.col("stop") - F.col("start")).cast("bigint").alias("span_len"))


def _whole(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All long stretches of texts that stand unchanged in another record."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, at, at + len(s)) for r, t in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True) for at, s in stretches(t, span)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), *[pa.array([x[k] for x in rows], pa.int32()) for k in (1, 2)]], ["rid", "start", "stop"])

    return scan


def _merged(spans: str) -> Column:
    """Overlapping and adjoining spans of an array sorted by start, joined."""
    return F.expr(
        f"""aggregate({spans}, cast(array() as array<struct<start:int,stop:int>>), (acc, x) ->
            if(size(acc) > 0 and x.start <= element_at(acc, -1).stop,
               concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start as start, greatest(element_at(acc, -1).stop, x.stop) as stop))),
               concat(acc, array(struct(x.start as start, x.stop as stop)))))"""
    )
