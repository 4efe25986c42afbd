"""Quality rules over pairs, each a predicate; findings, their summary and their reconciliation with decisions."""

from __future__ import annotations

import json
import subprocess
import sys
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.functions import text as tx
from tandemtext.functions.vectorized import newline_issues, numbers_differ
from tandemtext.operators import terms as glossary
from tandemtext.operators.policy import entry_rules, quality_policy


#: Rules whose findings cannot be set aside.
STRUCTURAL = ("newline_semantics",)


def exact_targets(memory: DataFrame) -> DataFrame:
    """The authoritative targets of each source: those of the permanent layer, else those of the runtime layers.

    `source, scope, targets` with the distinct displayed targets, sorted.
    """
    solid = memory.where(tx.stripped(F.coalesce("target", F.lit(""))) != "").select("source", "scope", "target").distinct()  # each text is displayed once
    sets = solid.withColumn("target", tx.normal_text(F.col("target"))).distinct().groupBy("source").agg(
        F.sort_array(F.collect_list(F.when(F.col("scope") == "permanent", F.col("target")))).alias("p"), F.sort_array(F.collect_list(F.when(F.col("scope") == "runtime", F.col("target")))).alias("r"),
    )
    first = F.size("p") > 0
    return sets.select("source", F.when(first, F.lit("permanent")).otherwise(F.lit("runtime")).alias("scope"), F.when(first, F.col("p")).otherwise(F.col("r")).alias("targets"))


def conflicts(df: DataFrame) -> DataFrame:
    """Sources with several distinct targets: `s, targets`; counted on distinct pairs, so a repeated pair is one row."""
    pairs = df.select(tx.normal_text(F.col("source")).alias("s"), tx.normal_text(F.col("target")).alias("t")).where("s <> '' and t <> ''").distinct()
    return pairs.groupBy("s").agg(F.sort_array(F.collect_list("t")).alias("targets")).where(F.size("targets") > 1)


def local_rules(policy: dict[str, Any]) -> dict[str, Column]:
    """Rules that look at one pair only, over the columns source, target, s and t (without markers)."""
    s, t = F.col("s"), F.col("t")
    ratio = policy["length_ratio"]
    share = F.length(tx.stripped(t)) / F.length(tx.stripped(s))
    normal_s, normal_t = tx.normal_text(F.col("source")), tx.normal_text(F.col("target"))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n")))
    shown = tx.rendered(F.col("target"))
    same = (s != "") & (normal_s == normal_t) & tx.has_kana(s)
    literal = policy["rules"].get("number_parity", {}).get("comparison") == "literal"
    return {
        "protected_token_parity": tx.bag(s, policy["protected_patterns"]) != tx.bag(t, policy["protected_patterns"]),
        "number_parity": tx.numbers(s) != tx.numbers(t) if literal else (s.rlike(r"(?U)\d") | t.rlike(r"(?U)\d")) & numbers_differ(s, t),
        "url_email_parity": tx.addresses(s) != tx.addresses(t),
        "newline_count": breaks(tx.normal_text(s)) != breaks(tx.normal_text(t)),
        "newline_semantics": (F.col("source").rlike("<tag|\n") | F.col("target").rlike("<tag|\n")) & (F.size(newline_issues(F.col("source"), F.col("target"), F.lit("source_guided"), F.lit(True), F.lit(True))) > 0),
        "newline_suspicious_break": shown.rlike(r"(?U)\d\n\d|[A-Za-z0-9_]\n[A-Za-z0-9_]") | shown.rlike(r"(?d)\n[ \t　]*[.,，。！？；：、…!?;:）】」』》]+[ \t　]*(?:\n|$)"),
        "whitespace": tx.whitespace_issue(s, t),
        "punctuation_balance": ~tx.balanced(t),
        "untranslated": same | (~same & tx.has_kana(t) & ~tx.has_han(t)),
        "length_ratio": (F.length(tx.stripped(s)) >= ratio["min_source_chars"]) & (F.length(tx.stripped(s)) > 0) & ((share < ratio["min"]) | (share > ratio["max"])),
    }


def findings(df: DataFrame, memory: DataFrame | None = None, terms: DataFrame | None = None, policy: dict[str, Any] | None = None) -> DataFrame:
    """Findings `finding_id, id, rule, severity, detail` of pairs `id, source, target, is_locked`.

    Locked pairs are skipped, null texts count as empty. All local rules are one scan; a memory adds the comparison with exact
    targets, a glossary that of terms; equal sources with other targets are a grouped join. `detail` is JSON with sorted keys, from which
    the id's hash is taken. Overrides of single entries are a join with their rules.
    """
    policy = policy or quality_policy()
    rules = entry_rules(policy, "")
    pairs = df.where(~F.coalesce("is_locked", F.lit(False))).select(F.col("id").cast("string").alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"))
    base = pairs.withColumns({"s": tx.plain(F.col("source")), "t": tx.plain(F.col("target"))})
    wanted = {r: c for r, c in local_rules(policy).items() if rules[r]["enabled"] or policy["entry_overrides"]}
    local = base.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in wanted.items()]))).alias("rule")).withColumn("detail", F.lit("{}"))
    parts = [local]
    if memory is not None:
        known = exact_targets(memory)
        hit = base.join(known, "source").withColumn("now", tx.normal_text(F.col("target")))
        wrong = hit.where(~F.array_contains("targets", F.col("now")) | (F.size("targets") > 1))
        parts.append(wrong.select("id", F.lit("tm_exact_target_mismatch").alias("rule"), F.to_json(F.struct("scope", "targets")).alias("detail")))
    if terms is not None:
        lost = glossary.missing(base.select("id", F.col("s").alias("text"), "target"), terms)
        parts.append(lost.select("id", F.lit("term_consistency").alias("rule"), F.to_json(F.struct("missing")).alias("detail")))
    many = conflicts(pairs)
    parts.append(base.withColumn("ns", tx.normal_text(F.col("source"))).join(many, F.col("ns") == many["s"]).select("id", F.lit("duplicate_consistency").alias("rule"), F.to_json(F.struct("targets")).alias("detail")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    spark = df.sparkSession
    general = spark.createDataFrame([(r, v["severity"], v["enabled"]) for r, v in rules.items()], "rule string, severity string, enabled boolean")
    out = found.join(F.broadcast(general), "rule")  # thirteen rules
    if policy["entry_overrides"]:
        own = [(e, r, v["severity"], v["enabled"]) for e in policy["entry_overrides"] for r, v in entry_rules(policy, e).items()]
        special = spark.createDataFrame(own, "id string, rule string, severity2 string, enabled2 boolean")
        out = out.join(special, ["id", "rule"], "left").withColumns({"severity": F.coalesce("severity2", "severity"), "enabled": F.coalesce("enabled2", "enabled")})
    kept = out.where("enabled")
    return kept.select(tx.finding_id(F.col("rule"), F.col("id"), F.col("detail")).alias("finding_id"), "id", "rule", "severity", "detail")


def summary(found: DataFrame) -> DataFrame:
    """Findings in all, by rule and by severity: `rule, severity, n` with nulls where not grouped by."""
    return found.groupingSets([["rule"], ["severity"], []], "rule", "severity").agg(F.count("*").alias("n"))


def with_plugin(found: DataFrame, extra: DataFrame, known: DataFrame) -> DataFrame:
    """Adds a plugin's findings `id, rule, severity, detail`; it can only append, only to known ids, under its own prefix."""
    checked = extra.join(known.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").where("severity in ('error', 'warning', 'info')")
    named = checked.withColumn("rule", F.concat(F.lit("plugin:"), F.regexp_replace("rule", "^plugin:", "")))
    return found.unionByName(named.select(tx.finding_id(F.col("rule"), F.col("id"), F.col("detail")).alias("finding_id"), "id", "rule", "severity", "detail"))


def reconcile(found: DataFrame, decisions: DataFrame, baseline: DataFrame, result: DataFrame) -> DataFrame:
    """Errors of decisions `finding_id, id, status, reason` on findings `finding_id, id, rule`: `finding_id, error`.

    baseline and result are `id, target` before and after. Errors: missing, duplicate, unknown, bad_status, other_id,
    fixed_but_unchanged, accepted_but_changed, no_reason, structural: a broken structure of line breaks is no matter of taste.
    """
    twice = decisions.groupBy("finding_id").agg(F.count("*").alias("times"))
    both = found.select("finding_id", F.col("id").alias("fid"), "rule").join(decisions, "finding_id", "full_outer").join(twice, "finding_id", "left")
    texts = baseline.select("id", F.coalesce("target", F.lit("")).alias("before")).join(result.select("id", F.coalesce("target", F.lit("")).alias("after")), "id", "full_outer").withColumnRenamed("id", "fid")
    rows = both.join(texts, "fid", "left")
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    decided = F.col("status").isNotNull()
    errors = F.array_compact(F.array(
        F.when(~decided & F.col("times").isNull(), F.lit("missing")), F.when(F.col("times") > 1, F.lit("duplicate")), F.when(F.col("fid").isNull(), F.lit("unknown")),
        F.when(F.col("times").isNotNull() & ~F.coalesce(F.col("status").isin("fixed", "false_positive"), F.lit(False)), F.lit("bad_status")), F.when(F.col("fid").isNotNull() & (F.col("id") != F.col("fid")), F.lit("other_id")),
        F.when((F.col("status") == "fixed") & F.col("fid").isNotNull() & ~changed, F.lit("fixed_but_unchanged")), F.when((F.col("status") == "false_positive") & F.col("fid").isNotNull() & changed, F.lit("accepted_but_changed")),
        F.when((F.col("status") == "false_positive") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), F.lit("no_reason")),
        F.when((F.col("status") == "false_positive") & F.col("rule").isin(*STRUCTURAL), F.lit("structural")),
    ))
    return rows.select("finding_id", F.explode(errors).alias("error")).distinct()


def remaining(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings of a second check that no decision set aside as a false positive."""
    return found.join(decisions.where("status = 'false_positive'").select("finding_id").distinct(), "finding_id", "left_anti")


def nested(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries with their findings as an array `findings`, in order of rule and id; empty where there are none."""
    each = found.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("rule", "finding_id", "severity", "detail"))).alias("findings"))
    joined = entries.join(each, F.col("id").cast("string") == F.col("_id"), "left").drop("_id")
    return joined.withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<rule:string,finding_id:string,severity:string,detail:string>>")))


def run_plugin(path: str, results: list[dict], entries: list[dict], found: list[dict], timeout: float = 30.0) -> list[dict]:
    """A project's own check as a process of its own: one JSON object in, exactly `{"findings": [...]}` out.

    For the entries of one batch, which is what fits in a task. The process gets no environment but its path, and at most
    `timeout` seconds. Anything else than well-formed findings on known ids is an error; with_plugin() adds them.
    """
    given = json.dumps({"schema_version": 1, "results": results, "entries": entries, "default_findings": found}, ensure_ascii=False)
    try:
        done = subprocess.run([sys.executable, "-I", path], input=given.encode(), capture_output=True, timeout=timeout, env={"PATH": "/usr/bin:/bin", "PYTHONIOENCODING": "utf-8"}, check=False)
    except subprocess.TimeoutExpired as e:
        raise RuntimeError(f"the plugin took more than {timeout} s") from e
    if done.returncode:
        raise RuntimeError(f"the plugin failed: {done.stderr.decode(errors='replace')[-500:]}")
    said = json.loads(done.stdout)
    if not isinstance(said, dict) or set(said) != {"findings"} or not isinstance(said["findings"], list):
        raise RuntimeError("the plugin may print findings only")
    ids = {str(e.get("id")) for e in entries}
    for f in said["findings"]:
        if not isinstance(f, dict) or not {"id", "rule", "severity", "message"} <= set(f) <= {"id", "rule", "severity", "message", "details"}:
            raise RuntimeError(f"malformed finding: {f}")
        if str(f["id"]) not in ids or f["severity"] not in ("error", "warning", "info"):
            raise RuntimeError(f"unknown id or severity: {f}")
    return [{"id": str(f["id"]), "rule": f["rule"], "severity": f["severity"], "detail": json.dumps({"details": f.get("details"), "message": f["message"]}, ensure_ascii=False, sort_keys=True)} for f in said["findings"]]
