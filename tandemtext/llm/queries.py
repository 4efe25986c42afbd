"""Queries of the training-data operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.llm import contamination, format_duplicates, lookalikes, mixture, near_duplicates, pair_defects, shared_spans, survivorship, truncation
from tandemtext.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches as they come about: the permanent memory, the runtime layers, the units; record ids of the two tables are told apart by their lowest bit."""
    entries = table(spark, sf_dir, "tm_store").select((F.col("entry_id") * 2).alias("rid"), F.col("source").alias("text"), F.coalesce(F.col("scope") == "runtime", F.lit(False)).alias("runtime"))
    units = table(spark, sf_dir, "transunit").select((F.col("unit_id") * 2 + 1).alias("rid"), F.col("source_text").alias("text"))
    spans = shared_spans.shared_spans([entries.where("not runtime"), entries.where("runtime"), units], index=shared_spans.FingerprintIndex(spark, fanout=2))
    name = F.when(F.col("rid") % 2 == 0, F.lit("tm_store")).otherwise(F.lit("transunit"))
    return spans.select(name.alias("tab"), F.shiftright("rid", 1).alias("row_id"), "span_start", "span_len")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    worked_on = table(spark, sf_dir, "transunit").where("status is null or status <> 'NotStarted'")
    found = pair_defects.pair_defects(worked_on, "unit_id", "source_text", "target_text")
    return found.select(F.col("id").alias("unit_id"), "defect")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = format_duplicates.format_duplicates(table(spark, sf_dir, "tm_store"), "entry_id", ["source", "target"])
    return groups.where("variants and id <> first_id").select(F.col("first_id").alias("first_entry_id"), F.col("id").alias("entry_id"))


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.collapsed(table(spark, sf_dir, "tm_store"), "entry_id", ["source", "target"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalikes.lookalike_pairs(table(spark, sf_dir, "transunit"), "unit_id", "source_text", table(spark, sf_dir, "tm_store"), "entry_id", "source")
    return pairs.select(F.col("left_id").alias("unit_id"), F.col("right_id").alias("entry_id"))


def p4_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.consistent_form(table(spark, sf_dir, "tm_store"), "entry_id", "source")


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["target", "file"]
    return survivorship.survivors(table(spark, sf_dir, "tm_store"), table(spark, sf_dir, "tm_files"), "entry_id", ["source", "context"], fields)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = survivorship.survivors(table(spark, sf_dir, "tm_store"), table(spark, sf_dir, "tm_files"), "entry_id", ["source", "context"], ["target"])
    return kept.where("target_dominant is not null").select(F.col("first_id").alias("first_entry_id"), F.col("target_dominant").alias("target_entry_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "tm_store"), "entry_id", "source", "target")
    return pairs.select(F.col("id_a").alias("entry_id_a"), F.col("id_b").alias("entry_id_b"))


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_links(table(spark, sf_dir, "tm_store"), "entry_id", "source", "target")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), overlaps=False)
    return found.where(F.col("run") >= contamination.Passages().run).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source").where("truncated").select(F.col("id").alias("doc_id"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p3_collapsed, p4_found, p4_consistent, p5_found, p5_survivors, p6_found, p6_links, p7_found, p7_leaks, p8_mixture, p8_shares, p9_found, p9_rates)
}

#: DuckDB's SQL for the queries that SQL can express on whole tables.
_WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _trimmed(column: str) -> str:
    return f"regexp_replace(coalesce({column}, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_TAG = r"<tag\b[^<>]*/>"
_SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _folded(column: str) -> str:
    return f"lower(regexp_replace(coalesce({column}, ''), '{_TAG}|[{_SPACE}\\p{{P}}]+', '', 'g'))"


def _form(column: str) -> str:
    parts = f"list_filter(string_split_regex(regexp_replace({column}, '{_TAG}', '', 'g'), '[／｜|;、\\n\\r]'), lambda p: regexp_matches(p, '[^{_SPACE}]'))"
    stat = f"(len({parts}) >= 3 AND len(list_filter({parts}, lambda p: NOT regexp_matches(p, '(?s)^[^:：]+[:：].*[^{_SPACE}]'))) = 0)"
    folded = f"list_transform({parts}, lambda p: {_folded('p')})"
    return f"CASE WHEN {stat} THEN '#' || array_to_string(list_sort(list_distinct(list_filter({folded}, lambda p: p <> ''))), '#') ELSE {_folded(column)} END"


#: Classes of equal folded entries, their sets of runs of three code points, the similar pairs of classes q, the members m.
_SIMILAR = f"""f AS (SELECT entry_id, {_folded("source")} AS a, {_folded("target")} AS b FROM tm_store), c AS (SELECT a, b, min(entry_id) AS cid FROM f WHERE length(a) >= 45 GROUP BY a, b),
t AS (SELECT DISTINCT cid, unnest(list_transform(range(1, greatest(length(a) - 1, 1)), lambda i: substr(a, i, 3)) || list_transform(range(1, greatest(length(b) - 1, 1)), lambda i: substr(b, i, 3))) AS g FROM c),
n AS (SELECT cid, count(*) AS n FROM t GROUP BY cid),
p AS (SELECT x.cid AS u, y.cid AS v, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.cid < y.cid GROUP BY 1, 2),
q AS (SELECT u, v FROM p JOIN n a ON a.cid = u JOIN n b ON b.cid = v WHERE k * 10 >= 7 * (a.n + b.n - k)),
m AS (SELECT f.entry_id, c.cid FROM f JOIN c ON f.a = c.a AND f.b = c.b)"""

#: p1, p6 and p7 compare all windows or sets that share something: quadratic in SQL, but quick on the tables the SQL is run on.
ORACLE_SQL: dict[str, str] = {
    "p1_found": f"""WITH r AS (SELECT 'tm_store' AS tab, entry_id AS id, source AS t FROM tm_store WHERE source IS NOT NULL UNION ALL SELECT 'transunit', unit_id, source_text FROM transunit WHERE source_text IS NOT NULL),
x AS (SELECT tab, id, string_split_regex(t, '{_TAG}') AS st, regexp_extract_all(t, '{_TAG}') AS tg FROM r),
s AS (SELECT tab, id, st, tg, unnest(range(1, len(st) + 1)) AS k FROM x),
y AS (SELECT tab, id, st[k] AS s, 1 + coalesce(list_sum(list_transform(range(1, k), lambda j: length(st[j]) + length(tg[j]))), 0) AS off FROM s),
w AS (SELECT tab, id, off + i AS pos, substr(s, i + 1, 40) AS w FROM (SELECT tab, id, s, off, unnest(range(0, greatest(length(s) - 39, 0))) AS i FROM y)),
h AS (SELECT w FROM w GROUP BY w HAVING count(DISTINCT tab || id) > 1),
c AS (SELECT tab, id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY tab, id ORDER BY pos) <= 40 THEN 0 ELSE 1 END AS new FROM w JOIN h ON w.w = h.w),
g AS (SELECT tab, id, pos, sum(new) OVER (PARTITION BY tab, id ORDER BY pos) AS run FROM c)
SELECT tab, id AS row_id, min(pos)::BIGINT AS span_start, (max(pos) + 40 - min(pos))::BIGINT AS span_len FROM g GROUP BY tab, id, run""",
    "p3_found": f"""WITH f AS (SELECT entry_id, source, target, {_form("coalesce(source, '')")} AS a, {_form("coalesce(target, '')")} AS b FROM tm_store),
g AS (SELECT a, b, min(entry_id) AS first_entry_id FROM f GROUP BY a, b HAVING count(DISTINCT coalesce('x' || source, '') || chr(1) || coalesce('x' || target, '')) > 1)
SELECT g.first_entry_id, f.entry_id FROM f JOIN g ON f.a = g.a AND f.b = g.b WHERE f.entry_id <> g.first_entry_id""",
    "p3_collapsed": f"""WITH f AS (SELECT entry_id, {_form("coalesce(source, '')")} AS a, {_form("coalesce(target, '')")} AS b FROM tm_store)
SELECT min(entry_id) AS id, count(*) AS copies FROM f GROUP BY a, b""",
    "p6_found": f"""WITH {_SIMILAR}
SELECT least(x.entry_id, y.entry_id) AS entry_id_a, greatest(x.entry_id, y.entry_id) AS entry_id_b FROM q JOIN m x ON x.cid = q.u JOIN m y ON y.cid = q.v""",
    "p6_links": f"""WITH {_SIMILAR}, l AS (SELECT cid, count(*) AS links FROM (SELECT u AS cid FROM q UNION ALL SELECT v FROM q) GROUP BY cid)
SELECT m.entry_id AS id, m.cid, coalesce(l.links, 0) AS links FROM m LEFT JOIN l ON l.cid = m.cid""",
    "p7_found": f"""WITH i AS (SELECT DISTINCT item_id, substr(f, unnest(range(1, greatest(length(f) - 68, 1))), 70) AS w FROM (SELECT item_id, {_folded("text")} AS f FROM eval_items)),
d AS (SELECT DISTINCT doc_id, substr(f, unnest(range(1, greatest(length(f) - 68, 1))), 70) AS w FROM (SELECT doc_id, {_folded("text")} AS f FROM documents))
SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i ON d.w = i.w""",
    "p5_found": f"""WITH e AS (SELECT entry_id, {_trimmed("source")} AS s, {_trimmed("context")} AS c, {_trimmed("target")} AS t,
lower({_trimmed("regexp_replace(" + _trimmed("file") + r", '^.*[/\\]', '')")}) AS f, committed_at AS cm FROM tm_store),
r AS (SELECT e.*, coalesce(m.trust, 0) AS trust FROM e LEFT JOIN tm_files m ON m.file = e.f WHERE s <> '' AND c <> ''),
g AS (SELECT s, c, min(entry_id) AS first_entry_id FROM r GROUP BY s, c HAVING count(*) > 1),
m AS (SELECT s, c, max(trust) AS trust, max(cm) AS cm FROM r WHERE t <> '' GROUP BY s, c)
SELECT g.first_entry_id, max(r.entry_id) AS target_entry_id
FROM g JOIN m ON g.s = m.s AND g.c = m.c JOIN r ON r.s = m.s AND r.c = m.c AND r.t <> '' AND r.trust = m.trust AND r.cm = m.cm
GROUP BY g.first_entry_id HAVING count(*) = 1""",
}
