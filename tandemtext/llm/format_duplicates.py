"""Duplicates hidden by formatting: records equal but for white space, letter case, punctuation or the order of fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.codepoints import fold_batch, mix64, segment_sums
from tandemtext.functions.folding import TAG, fold
from tandemtext.session import durable

#: The separators between the parts of a stat line, and the colons between label and value.
PART_SEPARATORS = "／｜|;、\n\r"
COLONS = ":："
_PARTS = re.compile(f"[{PART_SEPARATORS}]")
_LABELLED = re.compile(rf"[^{COLONS}]+[{COLONS}].*\S", re.DOTALL)


def stat_parts(text: str | None) -> list[str] | None:
    """The sorted distinct folded parts of a stat line (three or more parts `label: value` and no other), else None."""
    if text is None or text.count(":") + text.count("：") < 3:
        return None
    parts = [p for p in _PARTS.split(TAG.sub("", text)) if p.strip()]
    if len(parts) < 3 or not all(map(_LABELLED.match, parts)):
        return None
    return sorted({fold(p) for p in parts} - {""})


def canonical(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The forms by which texts are compared, as code points with offsets; a stat line's differs from that of any other text.

    Both the cheap invariants and the exact keys come from these forms, so texts with equal keys always have equal invariants.
    """
    return fold_batch(["\x01" + "\x02".join(parts) if (parts := stat_parts(t)) is not None else t for t in texts])


def _invariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cheap invariants: length and letter histogram of each field's form, the latter as a sum of a hash of each letter."""
    for b in batches:
        sig = np.zeros(b.num_rows, np.uint64)
        for k in range(1, b.num_columns):
            points, offsets = canonical(b.column(k).to_pylist())
            histogram = segment_sums(mix64(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), offsets)
            sig = mix64(sig * np.uint64(31) + histogram + np.diff(offsets).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(k))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig.view(np.int64))], ["id", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact keys: 128-bit hashes of the canonical forms and of the raw fields, in which null is no empty text."""
    for b in batches:
        raw = [b.column(k).to_pylist() for k in range(1, b.num_columns)]
        forms = [canonical(texts) for texts in raw]
        out = np.empty((b.num_rows, 4), np.int64)
        for i, fields in enumerate(zip(*raw, strict=True)):
            key, own = xxhash.xxh3_128(), xxhash.xxh3_128()
            for (points, offsets), t in zip(forms, fields, strict=True):
                part = points[offsets[i] : offsets[i + 1]].tobytes()
                key.update(len(part).to_bytes(8, "little") + part)
                part = b"" if t is None else t.encode("utf-8", "surrogatepass")
                own.update((-1 if t is None else len(part)).to_bytes(8, "little", signed=True) + part)
            out[i] = np.frombuffer(key.digest() + own.digest(), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[:, j]) for j in range(4)]], ["id", "k1", "k2", "r1", "r2"])


def format_duplicates(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Members of every group of records whose fields are equal but for formatting.

    Progressive refinement: one scan classes the rows by lengths and letter histogram, which cost a few vectorised operations
    a letter; only the members of classes with several rows are read again and get the exact keys, 128-bit hashes of the
    canonical forms. Classes are counted with partial aggregation, so that a class holding a third of all rows is a single row
    before the join that brings its members, which adaptive execution can split.

    Returns `first_id, id, copies, variants`: `first_id` the smallest id of the group, `copies` its rows, `variants` true if
    it has two different raw records. Every row of a group of two or more is returned. Null fields are compared as empty ones, so
    rows without any text form one group; a null and an empty field are different raw records. Rows with a null id are
    left out. Ids are expected to be unique; rows that share one are members each. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)]).where("id is not null")
    signed = durable(raw.mapInArrow(_invariants, "id bigint, sig bigint"), "format-invariants")
    several = signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    candidates = signed.join(several, "sig", "left_semi").select("id").distinct()
    members = durable(raw.join(candidates, "id", "left_semi").mapInArrow(_keys, "id bigint, k1 bigint, k2 bigint, r1 bigint, r2 bigint"), "format-members")
    groups = (
        members.groupBy("k1", "k2")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), ((F.min("r1") != F.max("r1")) | (F.min("r2") != F.max("r2"))).alias("variants"))
        .where("copies > 1")
    )
    return members.join(groups, ["k1", "k2"]).select("first_id", "id", "copies", "variants")


def collapsed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row for each record left after collapsing: `id, copies`, for all rows of the table (copies 1: no duplicate).

    Edge cases as in format_duplicates(); there is one row per group, its smallest id.
    """
    groups = format_duplicates(df, id_col, fields)
    later = groups.where("id <> first_id").select("id")
    firsts = groups.where("id = first_id").select("id", "copies").distinct()
    ids = df.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    return ids.join(later, "id", "left_anti").join(firsts, "id", "left").select("id", F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"))
