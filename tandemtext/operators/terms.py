"""Greedy longest-match dictionary join."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions import text as tx


def candidates(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Texts `id, text` with the distinct terms `ja` they contain: `id, ja`.

    Joined on the first two characters of a term (one for a term of one), taken only where a term can begin, so the glossary may
    have any size; Catalyst broadcasts it while it is below the session's threshold. The driver gets the first characters of
    all terms: no more than there are characters.
    """
    asked = terms.where("ja <> ''").select("ja").distinct().withColumn("head", F.substring("ja", 1, 2))
    begins = sorted({r["c"] for r in asked.select(F.substring("ja", 1, 1).alias("c")).distinct().collect()})
    if not begins:
        return texts.select("id", F.lit("").alias("ja")).where("false")
    first = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in begins) + "]"
    heads = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=({first}.?))"), F.lit(1)))
    both = F.array_distinct(F.concat(heads, F.transform(heads, lambda h: F.substring(h, 1, 1))))
    keyed = texts.where(F.length("text") > 0).select("id", "text", F.explode(both).alias("head"))
    return keyed.join(asked, "head").where(F.expr("contains(text, ja)")).select("id", "ja").distinct()


def accepted(text: str, found: list[str], order: dict[str, int] | None = None) -> list[str]:
    """The terms that keep an occurrence when longer terms, then earlier ones, take theirs first; only other terms block.

    All occurrences of a term are listed, then those on characters that no other term owns are taken from the left.
    """
    owner, kept = [0] * len(text), []
    for rank, ja in enumerate(sorted(found, key=lambda t: (-len(t), (order or {}).get(t, 0), t)), 1):
        free, size = 0, len(ja)
        for a in [m.start() for m in re.finditer(f"(?={re.escape(ja)})", text)]:
            if a >= free and {0, rank}.issuperset(owner[a : a + size]):
                owner[a : a + size], free = [rank] * size, a + size
        if rank in owner:
            kept.append(ja)
    return kept


@F.pandas_udf(T.ArrayType(T.StringType()))
def _accept(text: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([accepted(t, [x["ja"] for x in f], {x["ja"]: x["first"] for x in f}) for t, f in zip(text, found, strict=True)])


def matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Glossary rows for each text `id, text`: `id, ja, zh, note`, distinct; conflicting translations of a term stay apart.

    terms: `term_ord, ja, zh, note`. Null translations and notes count as empty.
    """
    firsts = terms.groupBy("ja").agg(F.min("term_ord").alias("first"))
    per = candidates(texts, terms).join(firsts, "ja").groupBy("id").agg(F.collect_list(F.struct("ja", "first")).alias("found"))
    kept = texts.join(per, "id").select("id", F.explode(_accept("text", "found")).alias("ja"))
    rows = terms.select("ja", F.coalesce("zh", F.lit("")).alias("zh"), F.coalesce("note", F.lit("")).alias("note")).distinct()
    return kept.join(rows, "ja").select("id", "ja", "zh", "note")


def missing(texts: DataFrame, terms: DataFrame, target: str = "target") -> DataFrame:
    """Terms whose translation the target lacks: `id, missing` (sorted array)."""
    found = matches(texts.select("id", F.col("text")), terms).where("trim(zh) <> ''").select("id", F.trim("zh").alias("zh")).distinct()
    return found.join(texts.select("id", tx.plain(F.col(target)).alias("t")), "id").where(F.expr("not contains(t, zh)")).groupBy("id").agg(F.sort_array(F.collect_set("zh")).alias("missing"))
