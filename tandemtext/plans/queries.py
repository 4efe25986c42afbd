"""Queries over the test tables, one or more per operator, each over its whole tables, with equivalent SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions import text as tx
from tandemtext.functions.vectorized import layout_of, nfkc
from tandemtext.operators import batching, layers, memory, quality, tasks, terms, validation
from tandemtext.session import table
from tandemtext.sources import bilingual

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transunit")


def _store(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tm_store")


#: Pieces of SQL: blanks as a class, texts without markers, segments, the display of tags.
WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TAG = r"<tag\b[^<>]*/>"
SEP = "[" + WS + r",.!?;:()\[\]{}「」『』、。！？…\-]+"
PLAIN = lambda c: f"regexp_replace(coalesce({c}, ''), '{TAG}', '', 'g')"
STRIP = lambda c: f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"
HALF = lambda c: f"translate({c}, '{tx.FULL_WIDTH}', '{tx.HALF_WIDTH.replace(chr(39), chr(39) * 2)}')"
SEGMENTS = lambda c: f"list_filter(regexp_split_to_array({HALF(f'regexp_replace({c}, {chr(39)}<[^>]+>{chr(39)}, chr(10), {chr(39)}g{chr(39)})')}, '{SEP}'), lambda x: x <> '')"
GRAMS = lambda c, n: f"list_distinct(flatten(list_transform({SEGMENTS(c)}, lambda s: list_transform(range(1, greatest(length(s) - {n - 1}, 0) + 1), lambda i: substr(s, i, {n})))))"
MARK = r"<tag\s+id=[''\"][^''\"]+[''\"]\s+type=[''\"]{0}[''\"]\s+desc=[''\"]{1}[''\"]\s*/>"


def _shown(c: str) -> str:
    q, out = "[^''\"]", c
    steps: list[tuple[str, str]] = []
    for name, short in tx.CLOSING_NAMES.items():
        steps.append((MARK.format("/" + q + "*", name + q + "{2}"), f"⟨/{short}⟩"))
        steps.append((MARK.format(q + "*", name + "结束"), f"⟨/{short}⟩"))
    steps += [(MARK.format("/" + q + "*", f"({q}*?){q}{{0,2}}"), r"⟨/\1⟩"), (MARK.format(q + "*", f"({q}*)结束"), r"⟨/\1⟩"), (MARK.format(q + "*", "换行"), "\n"), (MARK.format(q + "*", f"(⟨{q}*⟩)"), r"\1"), (MARK.format(q + "*", f"({q}*)"), r"⟨\1⟩")]
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


NORMAL = lambda c: STRIP(f"regexp_replace({_shown(f'coalesce({c}, {chr(39) * 2})')}, '\r\n?', chr(10), 'g')")
LOCKED = "NOT coalesce(is_locked, false)"


# Sources and scalar functions


@query("""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, trim(unnest(l), ' ' || chr(9) || chr(13)) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''""")
def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    return lines.select("doc_id", (F.col("n") + 1).cast("bigint").alias("line_no"), F.regexp_replace("raw", r"^[ \t\r]+|[ \t\r]+$", "").alias("line")).where("line <> ''")


@query("SELECT entry_id, regexp_replace(source, '<[^>]+>', '', 'g') AS plain, " + HALF("regexp_replace(source, '<[^>]+>', '', 'g')") + " AS half FROM tm_store")
def normalize_width(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).select("entry_id", tx.strip_markup(F.col("source")).alias("plain"), tx.normalized(F.col("source")).alias("half"))


@query(f"SELECT entry_id, array_to_string({SEGMENTS('source')}, '|') AS segs FROM tm_store")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).select("entry_id", F.array_join(tx.segments(F.col("source")), "|").alias("segs"))


@query(f"SELECT gram, count(*) AS df FROM (SELECT unnest({GRAMS('source', 3)}) AS gram FROM tm_store) GROUP BY gram")
def ngram_df(spark: SparkSession, d: str) -> DataFrame:
    return memory.document_frequency(memory.gram_table(_store(spark, d), "entry_id", "source", 3))


@query(f"SELECT unit_id, {NORMAL('source_text')} AS shown FROM transunit")
def display_text(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("unit_id", tx.normal_text(F.col("source_text")).alias("shown"))


@query()
def nfkc_text(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("unit_id", nfkc("source_text").alias("form"))


@query(r"""SELECT unit_id, tag_no, ph_id, tag_type, tag_desc FROM (
SELECT unit_id, unnest(range(1, len(t) + 1)) AS tag_no, regexp_extract(unnest(t), 'id=''([^'']*)''', 1) AS ph_id, regexp_extract(unnest(t), 'type=''([^'']*)''', 1) AS tag_type,
regexp_extract(unnest(t), 'desc=''([^'']*)''', 1) AS tag_desc FROM (SELECT unit_id, regexp_extract_all(source_text, '<tag\b[^<>]*/>') AS t FROM transunit WHERE source_text IS NOT NULL))""")
def tag_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = _units(spark, d).select("unit_id", F.posexplode(tx.tags(F.col("source_text"))).alias("n", "t"))
    return rows.select("unit_id", (F.col("n") + 1).cast("bigint").alias("tag_no"), F.col("t.id").alias("ph_id"), F.col("t.type").alias("tag_type"), F.col("t.desc").alias("tag_desc"))


@query()
def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("unit_id", layout_of("source_text").alias("l")).where("l.max_consecutive is not null").select("unit_id", "l.*")


# Memory


@query("""WITH p AS (SELECT source, context, entry_id, target, scope, batch FROM (
SELECT source, coalesce(context, '') AS context, target, entry_id, scope, batch, row_number() OVER (PARTITION BY source, coalesce(context, '') ORDER BY scope = 'permanent' DESC,
CASE WHEN scope = 'runtime' THEN coalesce(batch, -1) ELSE -1 END DESC, CASE WHEN scope = 'permanent' THEN -entry_id ELSE entry_id END DESC) AS k
FROM tm_store WHERE """ + STRIP("coalesce(target, '')") + """ <> '') WHERE k = 1) SELECT source, context, target, entry_id, scope, batch FROM p""")
def layered_precedence(spark: SparkSession, d: str) -> DataFrame:
    return memory.layered(_store(spark, d))


@query("SELECT min(entry_id) AS entry_id FROM tm_store WHERE " + STRIP("source") + " <> '' AND " + STRIP("coalesce(target, '')") + " <> '' GROUP BY " + STRIP("source") + ", " + STRIP("coalesce(context, '')"))
def tm_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return memory.first_wins(_store(spark, d)).select("entry_id")


_KEY = STRIP("coalesce(source, '')") + " AS s, " + STRIP("coalesce(context, '')") + " AS c"


@query(f"""WITH o AS (SELECT *, {_KEY}, coalesce(file, '') AS f FROM tm_store WHERE scope = 'permanent'), n AS (SELECT *, {_KEY}, coalesce(file, '') AS f FROM tm_store WHERE scope = 'runtime'),
x AS (SELECT s, c, min(entry_id) AS id, arg_min(f, entry_id) AS f FROM o GROUP BY s, c), u AS (SELECT s, c, f, max(entry_id) AS id FROM n GROUP BY s, c, f), l AS (SELECT coalesce(max(entry_id), 0) AS last FROM o),
w AS (SELECT x.id, n.target FROM x JOIN u ON x.s = u.s AND x.c = u.c AND x.f = u.f JOIN n ON n.entry_id = u.id),
a AS (SELECT s, c, min(entry_id) AS id, arg_min(f, entry_id) AS f FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.s = n.s AND o.c = n.c) GROUP BY s, c)
SELECT o.entry_id, CASE WHEN w.id IS NULL THEN o.target ELSE w.target END AS target FROM o LEFT JOIN w ON w.id = o.entry_id
UNION ALL SELECT l.last + a.id, m.target FROM a JOIN u ON u.s = a.s AND u.c = a.c AND u.f = a.f JOIN n m ON m.entry_id = u.id, l""")
def tm_upsert(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    return memory.upsert(store.where("scope = 'permanent'"), store.where("scope = 'runtime'")).select("entry_id", "target")


_G = lambda n: f"""SELECT q.id AS q, e.id AS e, count(*) AS shared, min(q.gram) AS first FROM q{n} q JOIN e{n} e ON q.gram = e.gram GROUP BY q.id, e.id"""


@query("WITH " + ", ".join(f"q{n} AS (SELECT unit_id AS id, unnest({GRAMS('source_text', n)}) AS gram FROM transunit WHERE unit_id % 20 = 0), e{n} AS (SELECT entry_id AS id, unnest({GRAMS('source', n)}) AS gram FROM tm_store)" for n in (3,))
       + f", c AS ({_G(3)}) SELECT q, e FROM (SELECT q, e, row_number() OVER (PARTITION BY q ORDER BY shared DESC, length(" + HALF("regexp_replace(t.source, '<[^>]+>', '', 'g')") + "), first, e) AS k FROM c JOIN tm_store t ON t.entry_id = c.e) WHERE k <= 300")
def recall_topk(spark: SparkSession, d: str) -> DataFrame:
    queries = _units(spark, d).where("unit_id % 20 = 0 and source_text is not null").select(F.col("unit_id").alias("q"), F.col("source_text").alias("source"))
    texts, members = memory.compact(_store(spark, d).select(F.col("entry_id").alias("e"), "source"), 300)
    return memory.pool(queries, texts, members, 3, 300).select("q", "e")


@query()
def fuzzy_tm_match(spark: SparkSession, d: str) -> DataFrame:
    queries = _units(spark, d).where("unit_id % 20 = 0 and source_text is not null").select(F.col("unit_id").alias("q"), F.col("source_text").alias("source"), "context")
    return memory.fuzzy_matches(queries, _store(spark, d).select(F.col("entry_id").alias("e"), "source", "context")).drop("layer")


@query()
def fragment_tm_match(spark: SparkSession, d: str) -> DataFrame:
    queries = _units(spark, d).where("unit_id % 20 = 0 and source_text is not null").select(F.col("unit_id").alias("q"), F.col("source_text").alias("source"))
    return memory.fragment_matches(queries, _store(spark, d).select(F.col("entry_id").alias("e"), "source", "target", "file")).drop("layer")


@query("SELECT t.ja AS fragment, count(DISTINCT s.source) AS sources, count(DISTINCT nullif(s.file, '')) AS files FROM (SELECT DISTINCT ja FROM terms WHERE length(ja) >= 4) t JOIN (SELECT DISTINCT source, file, unnest(" + SEGMENTS("source") + ") AS seg FROM tm_store) s ON contains(s.seg, t.ja) GROUP BY t.ja")
def fragment_support(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "terms").where("length(ja) >= 4").select(F.col("ja").alias("fragment"))
    return memory.fragment_support(asked, _store(spark, d)).drop("layer")


@query(f"""WITH t AS (SELECT DISTINCT source, scope, {NORMAL('target')} AS target FROM tm_store WHERE {STRIP("coalesce(target, '')")} <> ''),
p AS (SELECT source, bool_or(scope = 'permanent') AS p FROM t GROUP BY source)
SELECT t.source, t.scope, array_to_string(list_sort(list(t.target)), '|') AS targets FROM t JOIN p ON p.source = t.source WHERE t.scope = CASE WHEN p.p THEN 'permanent' ELSE 'runtime' END GROUP BY t.source, t.scope""")
def exact_tm_targets(spark: SparkSession, d: str) -> DataFrame:
    return quality.exact_targets(_store(spark, d)).select("source", "scope", F.array_join("targets", "|").alias("targets"))


# Terms


@query("SELECT u.unit_id AS id, t.ja FROM transunit u JOIN (SELECT DISTINCT ja FROM terms WHERE ja <> '') t ON contains(u.source_text, t.ja)")
def term_contains(spark: SparkSession, d: str) -> DataFrame:
    return terms.candidates(_units(spark, d).select(F.col("unit_id").alias("id"), F.col("source_text").alias("text")), table(spark, d, "terms"))


@query()
def term_matches(spark: SparkSession, d: str) -> DataFrame:
    return terms.matches(_units(spark, d).select(F.col("unit_id").alias("id"), tx.plain(F.col("source_text")).alias("text")), table(spark, d, "terms"))


# Ordered operators


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select(F.col("document").alias("doc"), F.col("unit_id").alias("ord"), F.length(tx.strip_markup(F.coalesce("source_text", F.lit("")))).alias("size"))


_FOLD = """WITH RECURSIVE r AS (SELECT document AS doc, unit_id AS ord, length(regexp_replace(coalesce(source_text, ''), '<[^>]+>', '', 'g')) AS size, row_number() OVER (PARTITION BY document ORDER BY unit_id) AS k FROM transunit),
f AS (SELECT doc, ord, size, k, 0::BIGINT AS batch_no, size AS total, 1 AS n FROM r WHERE k = 1 UNION ALL
SELECT r.doc, r.ord, r.size, r.k, CASE WHEN {0} AND f.total + r.size > {1} THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN {0} AND f.total + r.size > {1} THEN r.size ELSE f.total + r.size END, CASE WHEN {0} AND f.total + r.size > {1} THEN 1 ELSE f.n + 1 END
FROM f JOIN r ON r.doc = f.doc AND r.k = f.k + 1) SELECT doc, ord, size, batch_no FROM f"""


@query(_FOLD.format("f.total > 0", 2000))
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.greedy_batches(_sized(spark, d), 2000)


@query("SELECT doc, batch_no, count(*) AS rows, min(ord) AS first_ord, max(ord) AS last_ord, sum(size)::BIGINT AS size FROM (" + _FOLD.format("f.n > 0", 3000) + ") GROUP BY doc, batch_no")
def context_parts(spark: SparkSession, d: str) -> DataFrame:
    return batching.part_manifest(batching.context_parts(_sized(spark, d), 3000))


@query("""SELECT document AS doc, unit_id AS ord, coalesce(array_to_string(list_filter(list(coalesce(target_text, '')) OVER (PARTITION BY document ORDER BY unit_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), lambda x: trim(x, ' ') <> ''), '|'), '') AS before FROM transunit""")
def previous_context(spark: SparkSession, d: str) -> DataFrame:
    rows = batching.previous_context(_units(spark, d).select(F.col("document").alias("doc"), F.col("unit_id").alias("ord"), F.col("target_text").alias("text")))
    return rows.select("doc", "ord", F.array_join("before", "|").alias("before"))


# Aggregates


@query("""SELECT document, count(*) AS units, sum(length(regexp_replace(coalesce(source_text, ''), '<[^>]+>', '', 'g')))::BIGINT AS chars, count(*) FILTER (has_inline_tags) AS tagged,
count(*) FILTER (trim(coalesce(target_text, ''), ' ') <> '') AS targeted, count(*) FILTER (status = 'Confirmed') AS confirmed FROM transunit GROUP BY document""")
def doc_summary(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).groupBy("document").agg(
        F.count("*").alias("units"), F.sum(F.length(tx.strip_markup(F.coalesce("source_text", F.lit(""))))).alias("chars"), F.count_if("has_inline_tags").alias("tagged"),
        F.count_if(F.trim(F.coalesce("target_text", F.lit(""))) != "").alias("targeted"), F.count_if(F.col("status") == "Confirmed").alias("confirmed"),
    )


@query("""SELECT col, count(*) FILTER (v <> '') AS filled, count(*) FILTER (v LIKE '#%' OR v LIKE '//%') AS comments, count(*) FILTER (regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}') OR regexp_matches(v, '^\\d{2}:\\d{2}')) AS dates
FROM (SELECT unnest(['source_text', 'target_text', 'note', 'first_label']) AS col, unnest([coalesce(source_text, ''), coalesce(target_text, ''), coalesce(note, ''), coalesce(first_label, '')]) AS v FROM transunit) GROUP BY col""".replace("\\\\", "\\"))
def column_quality(spark: SparkSession, d: str) -> DataFrame:
    names = ["source_text", "target_text", "note", "first_label"]
    long = _units(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(c, F.lit("")).alias("v")) for c in names])).alias("x")).select("x.*")
    v = F.col("v")
    return long.groupBy("col").agg(F.count_if(v != "").alias("filled"), F.count_if(v.startswith("#") | v.startswith("//")).alias("comments"), F.count_if(v.rlike(r"^\d{4}-\d{2}-\d{2}") | v.rlike(r"^\d{2}:\d{2}")).alias("dates"))


# Quality rules


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select(F.col("unit_id").cast("string").alias("id"), F.col("source_text").alias("source"), F.col("target_text").alias("target"), "is_locked")


def _rule(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        base = _pairs(spark, d).where("not coalesce(is_locked, false)").withColumns({"source": F.coalesce("source", F.lit("")), "target": F.coalesce("target", F.lit(""))})
        return base.withColumns({"s": tx.plain(F.col("source")), "t": tx.plain(F.col("target"))}).where(quality.local_rules(quality.quality_policy())[name]).select("id")

    run.__name__ = f"qa_{name}"
    return run


_BASE = f"WITH b AS (SELECT unit_id::VARCHAR AS id, coalesce(source_text, '') AS source, coalesce(target_text, '') AS target, {PLAIN('source_text')} AS s, {PLAIN('target_text')} AS t FROM transunit WHERE {LOCKED}) SELECT id FROM b WHERE "
_ALL = lambda c, p: f"list_sort(regexp_extract_all({c}, '{p}'))"
_WORD = r"\p{L}\p{M}\p{N}_"  # letters of all scripts, as the rule has them
_URL = r"(?:https?://|ftp://|www\.)[^" + WS + r"<>\"'']+|[" + _WORD + ".+-]+@[" + _WORD + r".-]+\.[A-Za-z]{2,}"
_TOKENS = r"\$\{[^{}]+\}|%(?:\d+\$)?[sdif]|\{\d+\}|\\[nrt]"
_KANA = "[\\x{3040}-\\x{30FF}\\x{31F0}-\\x{31FF}]"
_escape = lambda c: "\\" + c if c.isascii() else c
_ESCAPED = "".join(_escape(c) for pair in tx.BRACKETS.items() for c in pair)


def _unbalanced(c: str, depth: int = 24) -> str:
    """Brackets alone, closed pairs taken out again and again; what is left is unbalanced (SQL needs a fixed depth)."""
    out = f"regexp_replace({c}, '[^{_ESCAPED}]', '', 'g')"
    pairs = "|".join(_escape(a) + _escape(z) for a, z in tx.BRACKETS.items())
    for _ in range(depth):
        out = f"regexp_replace({out}, '{pairs}', '', 'g')"
    return f"{out} <> ''"


_RENDERED = rf"regexp_replace(regexp_replace(target, '<tag\b[^<>]*\btype\s*=\s*(?:''br''|\"br\")[^<>]*/>', chr(10), 'g'), '{TAG}', chr(8232), 'g')"
_RULE_SQL = {
    "punctuation_balance": _unbalanced("t"),
    "newline_suspicious_break": rf"regexp_matches({_RENDERED}, '\p{{Nd}}\n\p{{Nd}}|[A-Za-z0-9_]\n[A-Za-z0-9_]') OR regexp_matches({_RENDERED}, '\n[ \t　]*[.,，。！？；：、…!?;:）】」』》]+[ \t　]*(?:\n|$)')",
    "protected_token_parity": f"{_ALL('s', _TOKENS)} <> {_ALL('t', _TOKENS)}",
    "url_email_parity": f"{_ALL('s', _URL)} <> {_ALL('t', _URL)}",
    "whitespace": f"t <> {STRIP('t')} OR (regexp_matches(t, '[ \\t]{{2,}}') AND NOT regexp_matches(s, '[ \\t]{{2,}}')) OR regexp_matches(t, '[ \\t]+[，。！？；：、》）】」』]')",
    "untranslated": f"(s <> '' AND {NORMAL('source')} = {NORMAL('target')} AND regexp_matches(s, '{_KANA}')) OR (NOT (s <> '' AND {NORMAL('source')} = {NORMAL('target')} AND regexp_matches(s, '{_KANA}')) AND regexp_matches(t, '{_KANA}') AND NOT regexp_matches(t, '[\\x{{4E00}}-\\x{{9FFF}}]'))",
    "length_ratio": f"length({STRIP('s')}) >= 4 AND (length({STRIP('t')}) / length({STRIP('s')}) < 0.25 OR length({STRIP('t')}) / length({STRIP('s')}) > 3.0)",
}
for _name in ("protected_token_parity", "number_parity", "url_email_parity", "newline_semantics", "newline_suspicious_break", "whitespace", "punctuation_balance", "untranslated", "length_ratio"):
    query(_BASE + _RULE_SQL[_name] if _name in _RULE_SQL else "")(_rule(_name))


@query(f"""WITH p AS (SELECT DISTINCT {NORMAL('source_text')} AS s, {NORMAL('target_text')} AS t FROM transunit WHERE {LOCKED})
SELECT s, array_to_string(list_sort(list(t)), '|') AS targets FROM p WHERE s <> '' AND t <> '' GROUP BY s HAVING count(*) > 1""")
def dup_consistency(spark: SparkSession, d: str) -> DataFrame:
    return quality.conflicts(_pairs(spark, d).where("not coalesce(is_locked, false)")).select("s", F.array_join("targets", "|").alias("targets"))


@query()
def qa_findings(spark: SparkSession, d: str) -> DataFrame:
    return quality.findings(_pairs(spark, d), _store(spark, d), table(spark, d, "terms"))


@query()
def qa_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(quality.findings(_pairs(spark, d), _store(spark, d), table(spark, d, "terms")))


# Reconciliation and validation


@query("SELECT coalesce(o.k, l.k) AS id, CASE WHEN l.k IS NULL THEN 'missing' WHEN o.k IS NULL THEN 'extra' ELSE 'duplicate' END AS code FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON o.k = l.k WHERE l.k IS NULL OR o.k IS NULL OR l.n > 1")
def reconcile_ids(spark: SparkSession, d: str) -> DataFrame:
    return validation.reconcile_ids(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("SELECT o.o_orderkey AS id, max_by(l.l_linenumber, l.l_linenumber)::INTEGER AS target FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1")
def last_result_wins(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").alias("target"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(validation.last_results(lines), "id")


@query()
def validation_violations(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    expected = units.select(F.col("unit_id").alias("id"), F.col("source_text").alias("source"), F.lit("").alias("baseline"), F.coalesce("is_locked", F.lit(False)).alias("locked"), F.lit(False).alias("source_locked"), F.lit(False).alias("preserve"), "maxlengthchars")
    return validation.violations(expected, units.where("status <> 'NotStarted'").select(F.col("unit_id").alias("id"), F.col("unit_id").alias("ord"), F.col("target_text").alias("target")))


_TAGS = r"regexp_extract_all({0}, '<tag\b[^<>]*/>')"


@query(f"""WITH b AS (SELECT unit_id AS id, {PLAIN('target_text')} AS t, try_cast(trim(maxlengthchars) AS INTEGER) AS m, maxlengthchars AS raw FROM transunit)
SELECT id, CASE WHEN m IS NULL THEN 'maxlength_unreadable' ELSE 'too_long' END AS code FROM b WHERE coalesce(raw, '') <> '' AND (m IS NULL OR (m >= 0 AND length(t) > m))""")
def maxlength_violations(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    expected = units.select(F.col("unit_id").alias("id"), F.col("source_text").alias("source"), F.lit("").alias("baseline"), F.lit(False).alias("locked"), F.lit(False).alias("source_locked"), F.lit(False).alias("preserve"), "maxlengthchars")
    found = validation.violations(expected, units.select(F.col("unit_id").alias("id"), F.col("unit_id").alias("ord"), F.col("target_text").alias("target")))
    return found.where("code in ('too_long', 'maxlength_unreadable')").select("id", "code")


@query(f"""WITH b AS (SELECT unit_id AS id, coalesce(target_text, '') AS t, CASE WHEN status = 'Pretranslated' THEN {STRIP("coalesce(target_text, '')")} ELSE '' END AS base, coalesce(is_locked, false) AS locked, status = 'Rejected' AND has_inline_tags AS preserve FROM transunit)
SELECT id, code FROM (SELECT id, CASE WHEN preserve OR (locked AND base <> '') THEN CASE WHEN t <> base THEN 'preserved_changed' END WHEN locked AND t <> base THEN 'locked_changed' END AS code FROM b
UNION ALL SELECT id, CASE WHEN NOT (preserve OR (locked AND base <> '')) AND {STRIP("t")} = '' THEN 'empty_target' END FROM b) WHERE code IS NOT NULL""")
def preserved_violations(spark: SparkSession, d: str) -> DataFrame:
    """Earlier targets of pretranslated units are those without outer blanks; rejected units with tags are to be preserved."""
    units = _units(spark, d)
    base = F.when(F.col("status") == "Pretranslated", tx.stripped(F.coalesce("target_text", F.lit("")))).otherwise("")
    expected = units.select(F.col("unit_id").alias("id"), F.col("source_text").alias("source"), base.alias("baseline"), F.col("is_locked").alias("locked"), F.lit(False).alias("source_locked"), ((F.col("status") == "Rejected") & F.col("has_inline_tags")).alias("preserve"), "maxlengthchars")
    found = validation.violations(expected, units.select(F.col("unit_id").alias("id"), F.col("unit_id").alias("ord"), F.col("target_text").alias("target")))
    return found.where("code in ('preserved_changed', 'locked_changed', 'empty_target')").select("id", "code")


_KEPT = lambda c: f"list_filter(regexp_extract_all({c}, '{TAG}'), lambda x: NOT contains(x, 'type=' || chr(39) || 'br' || chr(39)))"
_HAS = lambda name: f"regexp_matches(x, '\\b{name}\\s*=\\s*[''\"]')"


@query(f"""WITH b AS (SELECT unit_id AS id, coalesce(source_text, '') AS s, coalesce(target_text, '') AS t FROM transunit)
SELECT id, 'tag_exact' AS code FROM b WHERE {_KEPT("s")} <> {_KEPT("t")}
UNION ALL SELECT id, 'bare_tag' FROM b WHERE len(list_filter(regexp_extract_all(t, '</?[a-zA-Z][a-zA-Z0-9]*(?:=[^>]*)?>'), lambda x: NOT regexp_matches(x, '^<tag\\b'))) > 0
UNION ALL SELECT id, 'target_tag_malformed' FROM b WHERE len(list_filter(regexp_extract_all(t, '{TAG}'), lambda x: NOT ({_HAS("id")} AND {_HAS("type")}))) > 0 OR contains(regexp_replace(t, '{TAG}', '', 'g'), '<tag')""")
def tag_violations(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all targets against their sources, in order; markers are written in one way in these tables, so SQL compares them as text."""
    units = _units(spark, d)
    none = F.lit(False)
    expected = units.select(F.col("unit_id").alias("id"), F.col("source_text").alias("source"), F.lit("").alias("baseline"), none.alias("locked"), none.alias("source_locked"), none.alias("preserve"), "maxlengthchars")
    found = validation.violations(expected, units.select(F.col("unit_id").alias("id"), F.col("unit_id").alias("ord"), F.col("target_text").alias("target")))
    return found.where("code in ('tag_exact', 'bare_tag', 'target_tag_malformed')").select("id", "code")


# Layers and tasks


@query("SELECT scope, count(DISTINCT CASE WHEN scope = 'permanent' THEN 'permanent' ELSE 'runtime/' || coalesce(document, '') || '/' || coalesce(batch::VARCHAR, '') END) AS layers, count(*) AS entries FROM tm_store GROUP BY scope")
def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    return layers.layer_counts(_store(spark, d))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    base = F.when(F.col("status") != "NotStarted", F.col("target_text")).alias("baseline")
    return _units(spark, d).select(F.col("unit_id").alias("id"), F.col("source_text").alias("source"), F.col("target_text").alias("target"), "context", "note", base, "maxlengthchars", F.coalesce("is_locked", F.lit(False)).alias("source_locked"), F.lit(False).alias("preserve"), F.lit(None).cast("boolean").alias("locked"), "status", "has_inline_tags")


_TASKS = "b AS (SELECT unit_id AS id, source_text AS source, context, note, maxlengthchars, coalesce(CASE WHEN status <> 'NotStarted' THEN target_text END, '') AS base, coalesce(is_locked, false) AS sl FROM transunit)"


@query(f"""WITH {_TASKS}, h AS (SELECT *, sl OR {STRIP("base")} <> '' AS held FROM b) SELECT id, source, nullif(context, '') AS context,
nullif({STRIP("concat_ws(' ', nullif(note, ''), CASE WHEN sl THEN '" + tasks.SOURCE_LOCKED + "' WHEN held THEN '" + tasks.TARGET_LOCKED + "' END)")}, '') AS note, CASE WHEN held THEN base ELSE '' END AS target, held AS locked, CASE WHEN held THEN true END AS preserve_existing FROM h""")
def translate_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.translate_rows(_tasks(spark, d))


@query(f"""WITH {_TASKS} SELECT id, source, base AS translated, nullif(context, '') AS context, nullif(note, '') AS note, nullif(maxlengthchars, '') AS maxlengthchars, sl OR {STRIP("base")} <> '' AS locked, CASE WHEN sl THEN true END AS preserve_existing FROM b""")
def review_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.review_rows(_tasks(spark, d))


@query(f"SELECT unit_id AS id FROM transunit WHERE NOT coalesce(is_locked, false) AND {STRIP("coalesce(source_text, '')")} <> '' AND {STRIP("coalesce(target_text, '')")} = ''")
def untranslated_units(spark: SparkSession, d: str) -> DataFrame:
    return tasks.untranslated(_tasks(spark, d))


@query(f"SELECT count(*) AS units, count(*) FILTER ({STRIP("coalesce(target_text, '')")} <> '') AS targets, CASE WHEN count(*) FILTER ({STRIP("coalesce(target_text, '')")} <> '') = 0 THEN 'none' WHEN count(*) FILTER ({STRIP("coalesce(target_text, '')")} <> '') = count(*) THEN 'full' ELSE 'mixed' END AS mode FROM transunit")
def target_mode(spark: SparkSession, d: str) -> DataFrame:
    return tasks.target_mode(_tasks(spark, d))


@query(f"""WITH k AS (SELECT 'all' AS kind, '' AS name FROM transunit UNION ALL SELECT 'status', coalesce(status, '') FROM transunit UNION ALL SELECT 'tags', '' FROM transunit WHERE has_inline_tags
UNION ALL SELECT 'target', '' FROM transunit WHERE {STRIP("coalesce(target_text, '')")} <> '' UNION ALL SELECT 'context', split_part(context, '.', 1) FROM transunit WHERE coalesce(context, '') <> ''),
c AS (SELECT kind, name, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS r FROM k GROUP BY kind, name)
SELECT kind, name, n, printf('%.1f%%', n / (SELECT count(*) FROM transunit) * 100) AS share FROM c WHERE kind <> 'context' OR r <= 10""")
def file_info(spark: SparkSession, d: str) -> DataFrame:
    return tasks.file_info(_tasks(spark, d))


@query("""WITH c AS (SELECT unnest(['target_text', 'note', 'first_label']) AS col, unnest([0, 1, 2]) AS pos, unnest([trim(coalesce(target_text, ''), ' '), trim(coalesce(note, ''), ' '), trim(coalesce(first_label, ''), ' ')]) AS v FROM transunit),
p AS (SELECT col, pos, count(*) FILTER (v <> '') AS filled, count(*) FILTER (v LIKE '#%' OR v LIKE '//%' OR regexp_matches(v, '^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2})')) AS spoilt FROM c GROUP BY col, pos)
SELECT col AS "column", (CASE WHEN filled = 0 THEN 1000000000 ELSE spoilt END)::BIGINT AS penalty, filled FROM p ORDER BY penalty, filled DESC, pos LIMIT 1""")
def column_choice(spark: SparkSession, d: str) -> DataFrame:
    return bilingual.column_choice(_units(spark, d), ["target_text", "note", "first_label"])


@query()
def layered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Whole matches of every unit with an id divisible by 20 in all layers."""
    asked = _units(spark, d).where("unit_id % 20 = 0 and source_text is not null").select(F.col("unit_id").alias("q"), F.col("source_text").alias("source"), "context")
    return layers.whole_matches(asked, _store(spark, d).withColumnRenamed("entry_id", "e"))


@query()
def layered_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments for every unit from all layers."""
    asked = _units(spark, d).where("source_text is not null").select(F.col("unit_id").alias("q"), F.col("source_text").alias("source"), "context")
    return layers.fragments(asked, _store(spark, d).withColumnRenamed("entry_id", "e"))
