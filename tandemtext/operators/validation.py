"""Hard constraints on submitted results against the expected entries, as a table of violations."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.functions import text as tx
from tandemtext.functions.vectorized import newline_issues
from tandemtext.operators.policy import entry_validation, validation_policy


def reconcile_ids(expected: DataFrame, submitted: DataFrame) -> DataFrame:
    """Ids on one side only or submitted repeatedly: `id, code` with missing, extra, duplicate."""
    a = expected.groupBy("id").agg(F.lit(1).alias("e"))
    b = submitted.groupBy("id").agg(F.count("*").alias("n"))
    code = F.array_compact(F.array(F.when(F.col("n").isNull(), F.lit("missing")), F.when(F.col("e").isNull(), F.lit("extra")), F.when(F.col("n") > 1, F.lit("duplicate"))))
    return a.join(b, "id", "full_outer").select("id", F.explode(code).alias("code"))


def last_results(submitted: DataFrame) -> DataFrame:
    """One row per id of `id, ord, target`: the last."""
    return submitted.groupBy("id").agg(F.max_by("target", "ord").alias("target"))


def _by_policy(rows: DataFrame, policy: dict[str, Any]) -> list[tuple[DataFrame, dict[str, Any]]]:
    """The rows `id, ...` with each policy that holds for some of them: the general one, and one for all entries with equal overrides."""
    ids: dict[str, list[str]] = {}
    for entry in policy["entry_overrides"]:
        ids.setdefault(json.dumps(entry_validation(policy, entry), sort_keys=True, default=str), []).append(entry)
    general = {**entry_validation({**policy, "entry_overrides": {}}, ""), "allow_empty": False}
    if not ids:
        return [(rows, general)]
    numbered = [(entry, k) for k, some in enumerate(ids.values(), 1) for entry in some]
    marked = rows.withColumn("_key", F.col("id").cast("string")).join(rows.sparkSession.createDataFrame(numbered, "_key string, _policy int"), "_key", "left")
    part = lambda k: marked.where(F.coalesce("_policy", F.lit(0)) == k).drop("_key", "_policy")
    return [(part(0), general), *[(part(k), entry_validation(policy, some[0])) for k, some in enumerate(ids.values(), 1)]]


def violations(expected: DataFrame, submitted: DataFrame, policy: dict[str, Any] | None = None) -> DataFrame:
    """`id, severity, code, detail` of results `id, ord, target` against entries `id, source, baseline, locked, source_locked, preserve, maxlengthchars`.

    A preserved target (marked so, locked at the source, or locked with a text) must be unchanged and is checked no further.
    Entries with overrides are checked by their own policy.
    """
    p = validation_policy(policy)
    found = reconcile_ids(expected, submitted).select("id", F.lit("fatal").alias("severity"), "code", F.lit("").alias("detail"))
    both = expected.join(last_results(submitted), "id")
    for rows, own in _by_policy(both, p):
        found = found.unionByName(_checked(rows, own, p["allow_empty_ids"]))
    return found


def _checked(both: DataFrame, p: dict[str, Any], may_be_empty: list[str]) -> DataFrame:
    s, t, base = F.coalesce("source", F.lit("")), F.coalesce("target", F.lit("")), F.coalesce("baseline", F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    preserved = flag("preserve") | flag("source_locked") | (flag("locked") & (base != ""))
    kept = lambda x: F.filter(tx.tags(x), lambda m: ~F.array_contains(_strings(p["ignored_tag_types"]), m["type"]))
    parity = {"exact": kept(s) != kept(t), "count": F.size(kept(s)) != F.size(kept(t))}.get(p["tag_mode"], F.lit(False))
    forbidden = F.array_intersect(F.transform(tx.tags(t), lambda m: m["type"]), _strings(p["forbidden_target_tag_types"]))
    limit, size = F.expr("try_cast(trim(maxlengthchars) as int)"), F.length(tx.plain(t))
    limited = F.coalesce("maxlengthchars", F.lit("")) != ""
    allowed = F.lit(True) if p["allow_empty"] else F.col("id").cast("string").isin(may_be_empty) if may_be_empty else F.lit(False)
    one = lambda when, code, detail=F.lit(""), severity="fatal": F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail")))
    free = ~preserved
    rules = [
        one(preserved & (t != base), "preserved_changed"), one(free & flag("locked") & (t != base), "locked_changed"), one(free & (tx.stripped(t) == "") & ~allowed, "empty_target"),
        one(free & t.rlike(tx.BARE_TAG), "bare_tag"), one(free & tx.malformed(s), "source_tag_malformed"), one(free & tx.malformed(t), "target_tag_malformed"), one(free & parity, "tag_" + p["tag_mode"]),
        one(free & (F.size(forbidden) > 0), "forbidden_tag_type", F.array_join(F.sort_array(forbidden), ",")),
        one(free & limited & limit.isNull() & F.lit(p["enforce_maxlength"]), "maxlength_unreadable", F.coalesce("maxlengthchars", F.lit("")), "warning"),
        one(free & limited & (limit >= 0) & (size > limit) & F.lit(p["enforce_maxlength"]), "too_long", F.concat_ws(">", size.cast("string"), limit.cast("string"))),
    ]
    single = both.select("id", F.explode(F.array_compact(F.array(*rules))).alias("v")).select("id", "v.*")
    lines = p["newline_policy"]
    how = (F.lit(lines.get("mode", "source_guided")), F.lit(lines.get("preserve_paragraphs", True)), F.lit(lines.get("forbid_edge_breaks", True)))
    broken = both.where(free & (s.rlike("<tag|\n") | t.rlike("<tag|\n"))).select("id", F.explode(newline_issues(s, t, *how)).alias("detail"))
    return single.unionByName(broken.select("id", F.lit("fatal").alias("severity"), F.lit("newline_semantics").alias("code"), "detail"))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def audit_preserved(expected: DataFrame, policy: dict[str, Any] | None = None) -> DataFrame:
    """Format risks of preserved targets, which block nothing: `id, code`.

    Malformed markers end the audit of an entry; else forbidden types and a mismatch of tags by its policy are named. Null
    texts are no strings.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    kept = expected.where(flag("preserve") | flag("source_locked") | (flag("locked") & (F.coalesce("baseline", F.lit("")) != "")))
    s, base = F.col("source"), F.col("baseline")
    out = kept.where(s.isNull() | base.isNull()).select("id", F.lit("not_string").alias("code"))
    for rows, p in _by_policy(kept.where(s.isNotNull() & base.isNotNull()), validation_policy(policy)):
        tags = lambda x: F.filter(tx.tags(x), lambda m: ~F.array_contains(_strings(p["ignored_tag_types"]), m["type"]))  # noqa: E731, B023
        mismatch = {"exact": tags(s) != tags(base), "count": F.size(tags(s)) != F.size(tags(base))}.get(p["tag_mode"], F.lit(False))
        barred = F.arrays_overlap(F.transform(tx.tags(base), lambda m: m["type"]), _strings(p["forbidden_target_tag_types"]))
        bad = tx.malformed(s) | tx.malformed(base)
        codes = F.array_compact(F.array(F.when(bad, F.lit("malformed")), F.when(~bad & barred, F.lit("forbidden_tag_type")), F.when(~bad & mismatch, F.lit("tag_mismatch"))))
        out = out.unionByName(rows.select("id", F.explode(codes).alias("code")))
    return out


def wrapped_results(files: DataFrame, column: str = "value") -> DataFrame:
    """Results in JSON texts, a list of `id, target` or an object with such a list as `entries`: `ord, id, target, code`.

    Anything that is no such list is one row with the code `unreadable`; the object is accepted with the code `wrapped` on a row of its
    own; entries without a text as id or target have the code `bad_entry`. Good entries have a null code.
    """
    raw = files.select(F.trim(F.col(column)).alias("v")).withColumn("list", F.coalesce(F.when(F.col("v").startswith("["), F.col("v")), F.get_json_object("v", "$.entries")))
    parsed = raw.withColumn("rows", F.from_json("list", "array<string>"))
    good = parsed.select(F.posexplode("rows").alias("ord", "e")).select(F.col("ord").cast("bigint").alias("ord"), F.get_json_object("e", "$.id").alias("id"), F.get_json_object("e", "$.target").alias("target"))
    entries = good.withColumn("code", F.when(F.col("id").isNull() | F.col("target").isNull(), F.lit("bad_entry")))
    whole = parsed.select(F.lit(-1).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("target"), F.when(F.col("rows").isNull(), F.lit("unreadable")).when(~F.col("v").startswith("["), F.lit("wrapped")).alias("code"))
    return entries.unionByName(whole.where("code is not null"))
