"""Order-sensitive partitioning: greedy batches, context parts, trailing context.

A long document is worked on in blocks, side by side. How a block's batches fall depends on how full the open batch is when it
begins; as it can only be filled to the limit, each block is first summed up as a table from every possible filling to what
comes out, the tables of a document are chained, and a second pass numbers the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandemtext.session import durable

#: Rows of a document that are worked on in one task, about.
BLOCK_ROWS = 100_000
#: Fillings of the open batch: nothing in it yet; from limit + 1 on it is over the limit by its first row.
EMPTY = -1

Step = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def _step(limit: int, by_rows: bool) -> Step:
    """What a row of a size does to fillings: the new ones, and where a batch begins (by_rows: also after rows of size 0)."""

    def step(filling: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.maximum(filling, 0)
        begins = ((filling >= 0) if by_rows else (total > 0)) & (total + size > limit)
        return np.minimum(np.where(begins, size, total + size), limit + 1), begins

    return step


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Rows sorted by document and block, cut where these change: key, whether the segment begins here, rows."""
    last: tuple | None = None
    for b in batches:
        keys = list(zip(b.column("doc").to_pylist(), b.column("block").to_pylist(), strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z > a:
                yield keys[a], keys[a] != last, b.slice(a, z - a)
                last = keys[a]


def _tables(limit: int, step: Step) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block what comes of every filling: runs of fillings `upto` with the same `filling` at its end and number of `begun` batches."""
    schema = pa.schema([("doc", pa.string()), ("block", pa.int64()), ("upto", pa.list_(pa.int64())), ("filling", pa.list_(pa.int64())), ("begun", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, of, states, begun, base = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def table() -> pa.RecordBatch:
            end, number = states[of], base + begun[of]
            last = np.append(np.nonzero((end[1:] != end[:-1]) | (number[1:] != number[:-1]))[0], len(end) - 1)
            return pa.RecordBatch.from_pylist([{"doc": key[0], "block": key[1], "upto": (last + EMPTY).tolist(), "filling": end[last].tolist(), "begun": number[last].tolist()}], schema=schema)

        for now, new, part in _segments(batches):
            if new:
                if key is not None:
                    yield table()
                key, states = now, np.arange(EMPTY, limit + 2)
                of, begun, base = np.arange(len(states)), np.zeros(len(states), np.int64), np.zeros(len(states), np.int64)
            for k, size in enumerate(part.column("size").to_pylist()):
                states, begins = step(states, size)
                begun = begun + begins
                if len(states) > 1 and k % 16 == 0:  # fillings that have become equal go on as one
                    states, same = np.unique(states, return_inverse=True)
                    base += begun[of]
                    of, begun = same[of], np.zeros(len(states), np.int64)
        if key is not None:
            yield table()

    return scan


def _chained(x: pd.DataFrame) -> pd.DataFrame:
    """The filling and number with which each block of one document begins."""
    x = x.sort_values("block")
    filling, number, out = EMPTY, 0, []
    for r in x.itertuples():
        out.append((r.doc, r.block, filling, number))
        k = int(np.searchsorted(r.upto, filling))
        filling, number = int(r.filling[k]), number + int(r.begun[k])
    return pd.DataFrame(out, columns=["doc", "block", "filling", "number"])


def _numbers(step: Step) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling, number = np.zeros(1, np.int64), 0
        for _, new, part in _segments(batches):
            if new:
                filling, number = np.array([part.column("filling")[0].as_py()]), part.column("number")[0].as_py()
            out = []
            for size in part.column("size").to_pylist():
                filling, begins = step(filling, size)
                number += int(begins[0])
                out.append(number)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("ord"), part.column("size"), pa.array(out, pa.int64())], ["doc", "ord", "size", "batch_no"])

    return scan


def in_blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows `doc, ord, ...` with the `block` of their document, cut by ord; and the documents of several blocks, which are few."""
    sizes = rows.groupBy("doc").agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).where(F.col("n") > block_rows)
    long = durable(sizes.select("doc", "lo", F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / F.ceil(F.col("n") / block_rows)), F.lit(1)).alias("width")), "long-documents")
    placed = rows.join(long, "doc", "left").withColumn("block", F.coalesce(F.floor((F.col("ord") - F.col("lo")) / F.col("width")), F.lit(0)).cast("bigint"))
    return placed.drop("lo", "width"), long


def _numbered(df: DataFrame, limit: int, by_rows: bool, block_rows: int) -> DataFrame:
    step = _step(limit, by_rows)
    rows = df.select(F.col("doc").cast("string").alias("doc"), F.col("ord").cast("bigint").alias("ord"), F.col("size").cast("bigint").alias("size"))
    placed, long = in_blocks(rows, block_rows)
    ordered = lambda x: x.repartition("doc", "block").sortWithinPartitions("doc", "block", "ord")
    tables = ordered(placed.join(long.select("doc"), "doc", "left_semi").select("doc", "block", "ord", "size")).mapInArrow(_tables(limit, step), "doc string, block bigint, upto array<bigint>, filling array<bigint>, begun array<bigint>")
    begins = durable(tables.groupBy("doc").applyInPandas(_chained, "doc string, block bigint, filling bigint, number bigint"), "block-beginnings")
    known = placed.join(begins, ["doc", "block"], "left").withColumns({"filling": F.coalesce("filling", F.lit(EMPTY).cast("bigint")), "number": F.coalesce("number", F.lit(0).cast("bigint"))})
    return ordered(known.select("doc", "block", "ord", "size", "filling", "number")).mapInArrow(_numbers(step), "doc string, ord bigint, size bigint, batch_no bigint")


def greedy_batches(df: DataFrame, limit: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A new batch where the sum would pass the limit and is not 0; rows of size 0 never start one."""
    return _numbered(df, limit, False, block_rows)


def context_parts(df: DataFrame, limit: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A new part where the sum would pass the limit and the part has a row."""
    return _numbered(df, limit, True, block_rows)


def part_manifest(parts: DataFrame) -> DataFrame:
    """`doc, batch_no, rows, first_ord, last_ord, size` of each part."""
    return parts.groupBy("doc", "batch_no").agg(F.count("*").alias("rows"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.sum("size").alias("size"))


def previous_context(df: DataFrame, n: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row `doc, ord, text` the texts, if any, of the up to n rows before it: `doc, ord, before` (array, in order).

    The last rows of a long document's blocks are handed on to the blocks after them.
    """
    rows = df.select("doc", "ord", F.coalesce("text", F.lit("")).alias("text"))
    placed, long = in_blocks(rows, block_rows)
    ends = placed.join(long.select("doc"), "doc", "left_semi").withColumn("k", F.row_number().over(W.partitionBy("doc", "block").orderBy(F.desc("ord")))).where(F.col("k") <= n)
    blocks = ends.groupBy("doc", "block").agg(F.collect_list(F.struct("ord", "text")).alias("tail"))
    handed = blocks.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy("block")))
    earlier = F.flatten(F.collect_list("tail").over(W.partitionBy("doc").orderBy("place").rowsBetween(-n, -1)))  # n rows of each of n blocks
    listed = handed.withColumn("earlier", earlier).withColumn("earlier", F.array_sort("earlier")).withColumn("earlier", F.reverse(F.slice(F.reverse("earlier"), 1, n)))
    given = listed.select("doc", "block", F.explode("earlier").alias("x")).select("doc", "block", "x.ord", "x.text", F.lit(False).alias("own"))
    both = placed.select("doc", "block", "ord", "text", F.lit(True).alias("own")).unionByName(given)
    w = W.partitionBy("doc", "block").orderBy("ord").rowsBetween(-n, -1)
    before = both.withColumn("before", F.filter(F.collect_list("text").over(w), lambda t: F.trim(t) != ""))
    return before.where("own").select("doc", "ord", "before")
