"""Task rows for translators, reviewers and quality checks: projections, locks, export, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tandemtext.functions import text as tx

#: The fields that a document's analysis needs, in order, and the notes on what must not be changed.
ANALYSIS = ("id", "source", "target", "note", "context", "source_locked", "maxlengthchars")
SOURCE_LOCKED, TARGET_LOCKED = "【源文件锁定，严禁修改】", "【已有译文为只读基线，严禁修改或写回】"


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def baseline(translated: str = "translated", target: str = "target") -> Column:
    """The target that an entry must retain: an own one, else the target, else nothing."""
    return F.coalesce(F.col(translated), F.col(target), F.lit(""))


def preserved() -> Column:
    """Whether an entry `preserve, source_locked, locked, baseline` lies outside all write paths."""
    return flag("preserve") | flag("source_locked") | (flag("locked") & (F.coalesce("baseline", F.lit("")) != ""))


def writable(entries: DataFrame, submitted: DataFrame) -> DataFrame:
    """Submitted ids without the preserved ones."""
    return submitted.select("id").distinct().join(entries.where(preserved()).select("id"), "id", "left_anti")


def analysis_json(entries: DataFrame) -> DataFrame:
    """Each entry as JSON of the analysis fields; empty, false and missing ones are left out: `id, entry`."""
    fields = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) if c != "source_locked" else F.when(flag(c), F.lit(True)).alias(c) for c in ANALYSIS[1:]]
    return entries.select("id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), *fields)).alias("entry"))


def locks(review: bool = False) -> Column:
    """Whether a task's entry is locked: by its source, by preservation, never in a pure review, as it says itself, else if it has a text."""
    whole = F.when(flag("source_locked") | flag("preserve"), True)
    return whole.otherwise(False) if review else whole.when(F.col("locked").isNotNull(), F.col("locked")).otherwise(tx.stripped(F.coalesce("baseline", F.lit(""))) != "")


def translate_rows(entries: DataFrame) -> DataFrame:
    """Rows of a translation task: `id, source, context, note, target, locked, preserve_existing`; texts that are there are read-only."""
    held = flag("source_locked") | (tx.stripped(F.coalesce("baseline", F.lit(""))) != "")
    remark = F.when(flag("source_locked"), F.lit(SOURCE_LOCKED)).when(held, F.lit(TARGET_LOCKED))
    note = tx.stripped(F.concat_ws(" ", F.nullif("note", F.lit("")), remark))
    return entries.select(
        "id", "source", F.nullif("context", F.lit("")).alias("context"), F.nullif(note, F.lit("")).alias("note"),
        F.when(held, F.coalesce("baseline", F.lit(""))).otherwise("").alias("target"), held.alias("locked"), F.when(held, True).alias("preserve_existing"),
    )


def review_rows(entries: DataFrame, review: bool = False) -> DataFrame:
    """Rows of a review task: `id, source, translated, context, note, maxlengthchars, locked, preserve_existing`."""
    kept = [F.nullif(c, F.lit("")).alias(c) for c in ("context", "note", "maxlengthchars")]
    return entries.select("id", "source", F.coalesce("baseline", F.lit("")).alias("translated"), *kept, locks(review).alias("locked"), F.when(flag("source_locked") | flag("preserve"), True).alias("preserve_existing"))


def enriched(entries: DataFrame, terms: DataFrame, matches: DataFrame, fragments: DataFrame) -> DataFrame:
    """Entries as JSON with their terms, memory matches and fragments: `id, entry`; lists that are empty are left out.

    terms: `id, ja, zh, note`; matches and fragments as layers.lookup() gives them, with `q` the entry's id.
    """

    def listed(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in (key, *order)]
        return rows.groupBy(F.col(key).alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("row")))), lambda x: x["row"]).alias(name))

    permanent, runtime = F.col("scope") == "permanent", F.col("scope") == "runtime"
    parts = [
        listed(terms.withColumn("at", -F.length("ja")).withColumn("_ja", F.col("ja")).withColumn("_zh", F.col("zh")), "id", ["at", "_ja", "_zh"], "terms"),
        *[listed(rows.where(which), "q", ["pos"], prefix + name) for rows, name in ((matches, "tm_matches"), (fragments, "tm_fragments")) for which, prefix in ((permanent, ""), (runtime, "runtime_"))],
    ]
    out = entries
    for p in parts:
        out = out.join(p, "id", "left")
    return out.select("id", F.to_json(F.struct(*out.columns)).alias("entry"))


def memory_entries(units: DataFrame, targets: DataFrame, file: str) -> DataFrame:
    """What an import adds to the memory: submitted `id, target` of units `id, source, context, locked` that are neither locked nor blank nor tags alone."""
    rows = units.where(~flag("locked")).join(targets.where(tx.stripped(F.coalesce("target", F.lit(""))) != ""), "id")
    named = rows.select("id", tx.stripped(F.coalesce("source", F.lit(""))).alias("source"), tx.stripped(F.col("target")).alias("target"), F.coalesce("context", F.lit("")).alias("context"), F.lit(file).alias("file"))
    return named.where((F.col("source") != "") & (tx.stripped(tx.strip_markup(F.col("source"))) != ""))


def untranslated(units: DataFrame) -> DataFrame:
    """Units with a source whose target is blank and that may be written: what an export waits for."""
    return units.where(~preserved() & (tx.stripped(F.coalesce("source", F.lit(""))) != "") & (tx.stripped(F.coalesce("target", F.lit(""))) == "")).select("id")


def target_mode(units: DataFrame) -> DataFrame:
    """How many units have a target, and whether that is all of them, some or none: `units, targets, mode`."""
    counts = units.agg(F.count("*").alias("units"), F.count_if(tx.stripped(F.coalesce("target", F.lit(""))) != "").alias("targets"))
    return counts.withColumn("mode", F.when(F.col("targets") == 0, "none").when(F.col("targets") == F.col("units"), "full").otherwise("mixed"))


def percent(part: Column, total: Column) -> Column:
    """A share as text with one decimal; of nothing it is 0%."""
    return F.when(total == 0, F.lit("0%")).otherwise(F.format_string("%.1f%%", part.cast("double") / total * 100))


def file_info(units: DataFrame) -> DataFrame:
    """What a file's units are: `kind, name, n, share`, by status, with tags, with targets, and the ten most frequent first parts of contexts."""
    kinds = F.array_compact(F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("status").alias("kind"), F.coalesce("status", F.lit("")).alias("name")),
        F.when(flag("has_inline_tags"), F.struct(F.lit("tags").alias("kind"), F.lit("").alias("name"))),
        F.when(tx.stripped(F.coalesce("target", F.lit(""))) != "", F.struct(F.lit("target").alias("kind"), F.lit("").alias("name"))),
        F.when(F.coalesce("context", F.lit("")) != "", F.struct(F.lit("context").alias("kind"), F.substring_index("context", ".", 1).alias("name"))),
    ))
    counts = units.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    whole = counts.where("kind = 'all'").select(F.lit(1).alias("one"), F.col("n").alias("total"))  # one row
    shown = counts.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one").select("kind", "name", "n", percent(F.col("n"), F.col("total")).alias("share"))
    first = shown.where("kind = 'context'").orderBy(F.desc("n"), "name").limit(10)
    return shown.where("kind <> 'context'").unionByName(first)


def section(text: Column, marker: str) -> Column:
    """The part of a report from the line with the marker to the next heading; null where there is no such line."""
    found = F.regexp_extract(text, rf"(?s)(?:^|\n)([^\n]*{marker}.*?)(?=\n## |\n==== |$)", 1)
    return F.when(text.rlike(marker), found)


def problem_report(found: DataFrame, most: int = 20) -> DataFrame:
    """A line of Markdown for each code of `id, code`, by number: `line`, with the first ids in order.

    The first ids are cut by each task before the shuffle, so that a code on very many rows is no large group.
    """
    each = found.select("code", F.col("id").cast("string").alias("id")).distinct()
    first = each.withColumn("k", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("k") <= most).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    counts = found.groupBy("code").agg(F.count("*").alias("n"))
    return counts.join(first, "code").orderBy(F.desc("n"), "code").select(F.format_string("- %s: %d (%s)", "code", "n", F.array_join("ids", ", ")).alias("line"))
