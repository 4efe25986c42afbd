"""Bilingual spreadsheets: which columns hold source and target, their pairs, and a memory rebuilt from many files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions import text as tx
from tandemtext.operators import memory
from tandemtext.sources.files import _column, sheets

#: Words by which a header names a source or target column, tested in this order, and how a date or time begins.
SOURCE_WORDS = ("原文", "source", "ja", "jp", "日文", "日本語")
TARGET_WORDS = ("译文", "target", "zh", "sc", "cn", "中文", "簡体", "简体")
DATED = re.compile(r"\d{4}-\d{2}-\d{2}|\d{2}:\d{2}")
HEADER_ROWS = 5

Rows = list[tuple[int, dict[int, str]]]


def header(rows: Rows) -> tuple[int, list[int], list[int]]:
    """The first of the top rows that names a column, and its source and target columns; row 0 if none does."""
    for number, cells in rows:
        if number > HEADER_ROWS:
            break
        kinds = {c: "s" if any(w in v.lower() for w in SOURCE_WORDS) else "t" if any(w in v.lower() for w in TARGET_WORDS) else "" for c, v in sorted(cells.items())}
        if any(kinds.values()):
            return number, [c for c, k in kinds.items() if k == "s"], [c for c, k in kinds.items() if k == "t"]
    return 0, [], []


def cleanest(rows: Rows, columns: list[int]) -> int | None:
    """The column with the fewest comments and dates; then the fullest, then the leftmost. An empty one comes last."""

    def rank(c: int) -> tuple[float, int, int]:
        values = [cells[c] for _, cells in rows if cells.get(c)]
        spoilt = sum(v.startswith(("#", "//")) or bool(DATED.match(v)) for v in values)
        return spoilt if values else float("inf"), -len(values), c

    return min(columns, key=rank, default=None)


def columns_of(rows: Rows, source: str = "", target: str = "", header_row: int | None = None, clean: bool = False) -> tuple[int, int, int]:
    """Source column, target column and header row of a sheet, as given or as its header says; the two columns always differ.

    `clean` takes the cleanest of the source columns that the header names. A header_row of 0 means there is none.
    """
    found, sources, targets = header(rows)
    top = found if header_row is None else header_row
    below = [r for r in rows if r[0] > top]
    best = cleanest(below, sources) if clean else None
    s = best if best is not None else _column(source) if source else _column("A") if clean else (sources or [0])[0]
    t = _column(target) if target else targets[0] if targets else s
    return s, t if t != s else 2 if s == 1 else 1, top


def read_pairs(spark: SparkSession, path: str, glob: str = "*.xls[xm]", **options: object) -> DataFrame:
    """Pairs of all bilingual spreadsheets below a path: `file, row, source, target, context, error`; the first sheet of each counts.

    Rows without a source or a target are left out. A file that cannot be read gives one row with its error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("source", pa.string()), ("target", pa.string()), ("context", pa.string()), ("error", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                name = where.rpartition("/")[2]
                try:
                    rows = next(iter(sheets(content)))[1]
                    s, t, top = columns_of(rows, **options)
                    out = [{"file": name, "row": n, "source": cells[s], "target": cells[t], "context": f"{name}:Row{n}"} for n, cells in rows if n > top and cells.get(s) and cells.get(t)]
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    out = [{"file": name, "error": f"{type(e).__name__}: {e}"}]
                for a in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in out[a : a + 10_000]], schema=schema)

    return files.mapInArrow(parse, "file string, row bigint, source string, target string, context string, error string")


def rebuilt_memory(pairs: DataFrame) -> DataFrame:
    """A memory from the pairs of many files, folded in order of file name and row: of one source and context the first counts.

    `source, target, context, file`. No global numbering: the order is a key of two columns.
    """
    solid = pairs.where("error is null").withColumn("at", F.struct("file", "row"))
    return memory.first_wins(solid, "at").select(tx.stripped(F.col("source")).alias("source"), tx.stripped(F.col("target")).alias("target"), "context", "file")


def column_choice(df: DataFrame, columns: list[str]) -> DataFrame:
    """The cleanest of a table's text columns, as for a sheet: `column, penalty, filled`; counted for all columns in one scan."""
    counts = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(c).alias("column"), F.coalesce(F.trim(c), F.lit("")).alias("v")) for k, c in enumerate(columns)])).alias("x")).select("x.*")
    v = F.col("v")
    spoilt = v.startswith("#") | v.startswith("//") | v.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}:\d{2})")
    per = counts.groupBy("at", "column").agg(F.count_if(v != "").alias("filled"), F.count_if(spoilt).alias("spoilt"))
    scored = per.withColumn("penalty", F.when(F.col("filled") == 0, F.lit(10**9)).otherwise(F.col("spoilt")))
    return scored.orderBy("penalty", F.desc("filled"), "at").limit(1).select("column", "penalty", "filled")
