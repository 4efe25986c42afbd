import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tandemtext.operators import batching, memory, policy, quality, terms, validation

ENTRY = "entry_id bigint, source string, target string, context string, file string, scope string, batch int"


def store(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], ENTRY)


def test_recall_survives_truncated_pools(spark):
    rows = [(f"マテリアルシステムの説明{i}", "x", "", "f", "permanent", None) for i in range(600)] + [(s, s, "", "f", "permanent", None) for s in ("装備とマテリア", "マテリア", "魔法マテリア")]
    entries = store(spark, rows).withColumnRenamed("entry_id", "e")
    queries = spark.createDataFrame([(1, "装備とマテリア", "")], "q bigint, source string, context string")
    got = memory.fuzzy_matches(queries, entries).orderBy("rank").collect()
    assert [(r["e"], r["similarity"]) for r in got] == [(601, 1.0), (602, 0.7273), (603, 0.6154)]


def test_fuzzy_equals_full_scan(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("あいうえおかき") for _ in range(rng.randrange(3, 14)))
    sources = [text() for _ in range(120)]
    entries = store(spark, [(s, s, "", "f", "permanent", None) for s in sources]).withColumnRenamed("entry_id", "e")
    asked = [text() for _ in range(15)] + sources[:3]
    queries = spark.createDataFrame(list(enumerate(asked)), "q bigint, source string").withColumn("context", F.lit(""))
    got = {}
    for r in memory.fuzzy_matches(queries, entries).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["e"], r["similarity"]))
    for q, a in enumerate(asked):
        hits = [(-round(x, 4), i) for i, s in enumerate(sources, 1) if (x := SequenceMatcher(None, a, s).ratio()) >= 0.6]
        assert sorted(got.get(q, [])) == [(k, i, -x) for k, (x, i) in enumerate(sorted(hits)[:3], 1)]


def test_fragments(spark):
    rows = [("裏側の世界だ", "里侧的世界", "", "a", "permanent", None), ("これが裏側の世界", "里侧的世界吗", "", "b", "permanent", None), ("裏側の町", "里町", "", "a", "permanent", None)]
    entries = store(spark, rows).withColumnRenamed("entry_id", "e")
    queries = spark.createDataFrame([(1, "裏側の世界で待っています")], "q bigint, source string")
    first = memory.fragment_matches(queries, entries).orderBy("rank").first()
    assert (first["fragment"], first["files"], first["sources"]) == ("裏側の世界", 2, 2)
    tagged = store(spark, [("裏側<tag id='1' type='br' desc='换行'/>の世界", "x", "", "a", "permanent", None)]).withColumnRenamed("entry_id", "e")
    assert memory.fragment_matches(queries, tagged).count() == 0


def test_upsert_and_first_wins(spark):
    old = store(spark, [("s ", "old", "c", "a", "permanent", None), ("t", "t", None, "a", "permanent", None)])
    new = store(spark, [("s", "new", "c", "a", "runtime", 1), ("u", "u", "", "b", "runtime", 1), (" u", "v", "", "b", "runtime", 1)])
    get = lambda df: sorted((r["source"], r["target"]) for r in df.collect())
    assert get(memory.upsert(old, new)) == [(" u", "v"), ("s", "new"), ("t", "t")]
    assert get(memory.upsert(old, new, replace=False)) == [("s ", "old"), ("t", "t"), ("u", "u")]
    assert get(memory.upsert(old, new.withColumn("file", F.lit("z")))) == [(" u", "v"), ("s ", "old"), ("t", "t")]
    again = memory.upsert(memory.upsert(old, new), new)
    assert get(again) == get(memory.upsert(old, new))
    assert [r["entry_id"] for r in memory.first_wins(new.unionByName(new.withColumn("entry_id", F.col("entry_id") + 10))).orderBy("entry_id").collect()] == [1, 2]


def test_upsert_with_null_files_and_repeated_keys(spark):
    old = store(spark, [("s", "a", "c", None, "permanent", None), ("s", "b", "c", "", "permanent", None), ("t", "t", None, "x", "permanent", None)])
    new = store(spark, [("s", "n1", "c", "", "runtime", 1), ("s", "n2", "c", None, "runtime", 1), ("t", "no", "", None, "runtime", 1), ("u", "u1", "", None, "runtime", 1), ("u", "u2", "", "y", "runtime", 1), ("u", "u3", "", "", "runtime", 1)])
    rows = sorted((r["source"], r["target"]) for r in memory.upsert(old, new).collect())
    assert rows == [("s", "b"), ("s", "n2"), ("t", "t"), ("u", "u3")]
    assert sorted(r["target"] for r in memory.upsert(old, new, replace=False).collect()) == ["a", "b", "t", "u1"]
    assert memory.append(old, new).count() == 9 and memory.append(old, new).select("entry_id").distinct().count() == 9


def test_layers(spark):
    rows = [("s", "run1", "", "f", "runtime", 1), ("s", "perm", "", "f", "permanent", None), ("t", "run1", None, "f", "runtime", 1), ("t", "run2", "", "f", "runtime", 2), ("t", " ", "", "f", "runtime", 3)]
    got = {r["source"]: r["target"] for r in memory.layered(store(spark, rows)).collect()}
    assert got == {"s": "perm", "t": "run2"}


def test_terms(spark):
    glossary = spark.createDataFrame([(1, "用語", "术语", "n"), (2, "用語", "术语", "n"), (3, "用語", "词", None), (4, "語", "语", "")], "term_ord bigint, ja string, zh string, note string")
    texts = spark.createDataFrame([(1, "用語と用語"), (2, "語"), (3, ""), (4, None)], "id bigint, text string")
    got = sorted((r["id"], r["ja"], r["zh"]) for r in terms.matches(texts, glossary).collect())
    assert got == [(1, "用語", "术语"), (1, "用語", "词"), (2, "語", "语")]


def test_greedy_terms_against_positions():
    rng = random.Random(1)
    for _ in range(300):
        text, words = "".join(rng.choice("ab") for _ in range(12)), {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(4)}
        owner = [None] * len(text)
        kept = set()
        for w in sorted(words, key=lambda w: (-len(w), w)):
            i = 0
            while i + len(w) <= len(text):
                if text[i : i + len(w)] == w and all(o in (None, w) for o in owner[i : i + len(w)]):
                    owner[i : i + len(w)] = [w] * len(w)
                    kept.add(w)
                    i += len(w)
                else:
                    i += 1
        assert set(terms.accepted(text, list(words))) == kept


@pytest.mark.parametrize("partitions", [1, 7])
def test_batches(spark, partitions):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate([5, 0, 6, 0, 20, 1])] + [("e", 0, 0), ("e", 1, 50)], "doc string, ord bigint, size bigint").repartition(partitions)
    get = lambda x: [(r["doc"], r["batch_no"]) for r in x.orderBy("doc", "ord").collect()]
    assert get(batching.greedy_batches(df, 10)) == [("d", 0), ("d", 0), ("d", 1), ("d", 1), ("d", 2), ("d", 3), ("e", 0), ("e", 0)]
    assert get(batching.context_parts(df, 10))[-2:] == [("e", 0), ("e", 1)]
    assert batching.greedy_batches(df.limit(0), 10).count() == 0


@pytest.mark.parametrize("kind", [batching.greedy_batches, batching.context_parts])
def test_long_documents_in_blocks(spark, kind):
    """Blocks of a few rows, with gaps between their places, give what one pass gives."""
    rng = random.Random(9)
    rows, at = [], 0
    for _ in range(400):
        at += rng.choice([1, 1, 1, 40])
        rows.append(("d", at, rng.choice([0, 0, 1, 2, 3, 5, 9, 14])))
    rows += [("e", k, 3) for k in range(5)] + [(None, 1, 20), (None, 2, 0), (None, 3, 1)]
    df = spark.createDataFrame(rows, "doc string, ord bigint, size bigint")
    want = {}
    for doc in ("d", "e", None):
        total = number = 0
        count = 0
        for d, o, size in rows:
            if d == doc:
                if (count > 0 if kind is batching.context_parts else total > 0) and total + size > 12:
                    number, total, count = number + 1, 0, 0
                total, count = total + size, count + 1
                want[d, o] = number
    got = {(r["doc"], r["ord"]): r["batch_no"] for r in kind(df, 12, block_rows=7).collect()}
    assert got == want and {(r["doc"], r["ord"]): r["batch_no"] for r in kind(df, 12).collect()} == want


def test_context_across_blocks(spark):
    rows = [("d", k * (1 if k % 9 else 7) + k * 30, None if k % 4 == 0 else f"t{k}") for k in range(60)] + [("e", 1, "x"), ("e", 2, "y")]
    df = spark.createDataFrame(rows, "doc string, ord bigint, text string")
    get = lambda n, size: {(r["doc"], r["ord"]): r["before"] for r in batching.previous_context(df, n, size).collect()}
    ordered = sorted(r for r in rows if r[0] == "d")
    want = {(d, o): [t for _, _, t in ordered[max(0, i - 5) : i] if t] for i, (d, o, _) in enumerate(ordered)} | {("e", 1): [], ("e", 2): ["x"]}
    assert get(5, 100_000) == want and get(5, 3) == want and get(5, 1) == want


def test_policy_quirks():
    q = policy.quality_policy({"rules": {"url_email_parity": {"enabled": True}, "whitespace": {}}, "ignore_rule_ids": ["untranslated"], "entry_overrides": {"7": {"disabled_rules": ["length_ratio"], "rules": {"untranslated": {"enabled": True}, "newline_count": {"enabled": True}}}}})
    rules = policy.entry_rules(q, "7")
    assert rules["url_email_parity"]["severity"] == "warning" and not rules["whitespace"]["enabled"]
    assert not rules["length_ratio"]["enabled"] and not rules["untranslated"]["enabled"] and rules["newline_count"]["enabled"]
    v = policy.validation_policy({"enforce_newline_count": True, "entry_overrides": {"1": {"newline_policy": {"mode": "free"}}}})
    assert v["newline_policy"]["mode"] == "exact" and policy.entry_validation(v, "1")["newline_policy"] == {"mode": "free"}
    with pytest.raises(ValueError):
        policy.quality_policy({"nonsense": 1})
    assert policy.revision(policy.validation_policy(), policy.quality_policy()) != policy.revision(v, q)


def pairs(spark, rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, source string, target string, is_locked boolean")


def test_findings(spark):
    rows = [("価格は${x}と3", "价格是${x}和4", None), ("同じ", "同じ", False), ("とても長い文章です", "短", False), ("same source", "译文一", False), ("same source", "译文二", False), ("（a）", "（a", False), ("ほげ", "ほげ", True), (None, None, None)]
    found = quality.findings(pairs(spark, rows))
    got = {(r["id"], r["rule"]) for r in found.collect()}
    assert got == {("0", "number_parity"), ("1", "untranslated"), ("2", "length_ratio"), ("3", "duplicate_consistency"), ("4", "duplicate_consistency"), ("5", "punctuation_balance")}
    assert {(r["rule"], r["severity"]): r["n"] for r in quality.summary(found).collect()}[(None, None)] == 6
    off = policy.quality_policy({"entry_overrides": {"1": {"disabled_rules": ["untranslated"]}}})
    assert ("1", "untranslated") not in {(r["id"], r["rule"]) for r in quality.findings(pairs(spark, rows), policy=off).collect()}


def test_exact_memory_and_terms(spark):
    tm = store(spark, [("源", "译", "", "f", "permanent", None), ("源", "别", "", "f", "runtime", 1), ("双", "一", "", "f", "runtime", 1), ("双", "二", "", "f", "runtime", 1)])
    glossary = spark.createDataFrame([(1, "源", "源头", None)], "term_ord bigint, ja string, zh string, note string")
    found = quality.findings(pairs(spark, [("源", "别", False), ("源", "译", False), ("双", "一", False)]), tm, glossary)
    got = {(r["id"], r["rule"]) for r in found.collect()}
    assert ("0", "tm_exact_target_mismatch") in got and ("1", "tm_exact_target_mismatch") not in got and ("2", "tm_exact_target_mismatch") in got
    assert ("0", "term_consistency") in got


def test_reconcile_decisions(spark):
    found = spark.createDataFrame([("f1", "1", "a"), ("f2", "2", "newline_semantics"), ("f3", "3", "a"), ("f4", "4", "a")], "finding_id string, id string, rule string")
    decisions = spark.createDataFrame([("f1", "1", "fixed", ""), ("f2", "2", "false_positive", ""), ("f3", "3", "what", "r"), ("f3", "3", "what", "r"), ("f9", "9", "fixed", "")], "finding_id string, id string, status string, reason string")
    texts = spark.createDataFrame([(str(i), "t") for i in range(1, 5)], "id string, target string")
    got = sorted((r["finding_id"], r["error"]) for r in quality.reconcile(found, decisions, texts, texts).collect())
    assert got == [("f1", "fixed_but_unchanged"), ("f2", "no_reason"), ("f2", "structural"), ("f3", "bad_status"), ("f3", "duplicate"), ("f4", "missing"), ("f9", "unknown")]


def test_plugin_only_appends(spark):
    found = quality.findings(pairs(spark, [("同じ", "同じ", False)]))
    extra = spark.createDataFrame([("0", "mine", "info", "{}"), ("77", "mine", "info", "{}"), ("0", "bad", "loud", "{}")], "id string, rule string, severity string, detail string")
    assert sorted(r["rule"] for r in quality.with_plugin(found, extra, pairs(spark, [("a", "b", False)])).collect()) == ["plugin:mine", "untranslated"]


def test_violations(spark):
    schema = "id string, source string, baseline string, locked boolean, source_locked boolean, preserve boolean, maxlengthchars string"
    tag = "<tag id='1' type='fmt' desc='x'/>"
    expected = spark.createDataFrame([("1", "a", "old", True, False, False, None), ("2", tag + "a", "", False, False, False, "1"), ("3", "a", "", False, False, False, "none"), ("4", "a", "", None, None, None, None), ("5", "a", "", False, False, False, None)], schema)
    submitted = spark.createDataFrame([("1", 1, "new"), ("2", 1, "bb<i>"), ("3", 1, "ok"), ("4", 1, " "), ("9", 1, "x"), ("9", 2, "x")], "id string, ord bigint, target string")
    got = {(r["id"], r["code"]) for r in validation.violations(expected, submitted).collect()}
    assert got == {("1", "preserved_changed"), ("2", "bare_tag"), ("2", "tag_exact"), ("2", "too_long"), ("3", "maxlength_unreadable"), ("4", "empty_target"), ("5", "missing"), ("9", "extra"), ("9", "duplicate")}


def test_policies_of_single_entries(spark):
    schema = "id string, source string, baseline string, locked boolean, source_locked boolean, preserve boolean, maxlengthchars string"
    br = "<tag id='1' type='br' desc='换行'/>"
    color = "<tag id='2' type='fmt' desc='x'/>"
    expected = spark.createDataFrame([(str(i), color + "甲" + br + "乙", "", False, False, False, "3") for i in range(1, 6)], schema)
    submitted = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate((br + "一二三四", br + "一二三四", "", color + "一" + br + "二", "一"), 1)], "id string, ord bigint, target string")
    given = {"entry_overrides": {"1": {"tag_mode": "ignore", "enforce_maxlength": False, "newline_policy": {"mode": "free", "forbid_edge_breaks": False}}, "3": {"allow_empty": True, "tag_mode": "ignore"}, "4": {"forbidden_target_tag_types": ["fmt"]}}}
    got = {(r["id"], r["code"], r["detail"]) for r in validation.violations(expected, submitted, given).collect()}
    assert got == {("2", "tag_exact", ""), ("2", "too_long", "4>3"), ("2", "newline_semantics", "leading_break"), ("4", "forbidden_tag_type", "fmt"), ("5", "tag_exact", "")}
    with pytest.raises(ValueError):
        policy.validation_policy({"entry_overrides": {"1": {"tagmode": "ignore"}}})
    kept = spark.createDataFrame([("1", color, "x"), ("4", color, color), ("5", color, "<tag oops"), ("6", "a", None), ("7", color, "x")], "id string, source string, baseline string").withColumns({"locked": F.lit(False), "source_locked": F.lit(True), "preserve": F.lit(False)})
    assert {(r["id"], r["code"]) for r in validation.audit_preserved(kept, given).collect()} == {("4", "forbidden_tag_type"), ("5", "malformed"), ("6", "not_string"), ("7", "tag_mismatch")}
    assert policy.load(None, "quality") == policy.quality_policy() and policy.load('{"tag_mode": "count"}', "validation")["tag_mode"] == "count"
    assert policy.one_revision(["a", "a"]) == "a"


def test_wrapped_results(spark):
    files = spark.createDataFrame([('[{"id": "1", "target": "a"}, {"id": "2"}]',), ('{"entries": [{"id": "3", "target": "b"}]}',), ("what",)], "value string")
    got = {(r["id"], r["target"], r["code"]) for r in validation.wrapped_results(files).collect()}
    assert got == {("1", "a", None), ("2", None, "bad_entry"), ("3", "b", None), (None, None, "wrapped"), (None, None, "unreadable")}


def test_findings_on_entries_and_what_remains(spark):
    rows = [("同じ", "同じ", False), ("a", "b", False)]
    found = quality.findings(pairs(spark, rows))
    got = {r["id"]: [f["rule"] for f in r["findings"]] for r in quality.nested(pairs(spark, rows), found).collect()}
    assert got == {"0": ["untranslated"], "1": []}
    decisions = found.select("finding_id", "id", F.lit("false_positive").alias("status"), F.lit("r").alias("reason"))
    assert quality.remaining(found, decisions).count() == 0 and quality.remaining(found, decisions.withColumn("status", F.lit("fixed"))).count() == 1


def test_plugin_process(tmp_path):
    def plugin(code):
        (tmp_path / "p.py").write_text("import json, sys, time\nd = json.load(sys.stdin)\n" + code)
        return lambda timeout=5: quality.run_plugin(str(tmp_path / "p.py"), [], [{"id": 1}], [], timeout)

    said = plugin("print(json.dumps({'findings': [{'id': e['id'], 'rule': 'r', 'severity': 'info', 'message': 'm'} for e in d['entries']]}))")()
    assert said == [{"id": "1", "rule": "r", "severity": "info", "detail": '{"details": null, "message": "m"}'}]
    for code in ("print(json.dumps({'findings': [], 'more': 1}))", "print(json.dumps({'findings': [{'id': '2', 'rule': 'r', 'severity': 'info', 'message': 'm'}]}))", "raise SystemExit(3)"):
        with pytest.raises(RuntimeError):
            plugin(code)()
    with pytest.raises(RuntimeError, match="took more"):
        plugin("time.sleep(5)")(0.2)


def test_layered_lookup(spark):
    from tandemtext.operators import layers

    rows = [
        (1, "装備とマテリア", "装备与魔石", "m", "a", "permanent", None, None), (2, "装備とマテリア", "旧", "m", "r1", "runtime", 1, "d"), (3, "装備とマテリア", "新", "m", "r2", "runtime", 2, "d"),
        (4, "魔法マテリアの説明文を読む", "读", "", "a", "permanent", None, None), (5, "裏側の世界だ", "里侧", "", "r1", "runtime", 1, "d"), (6, "これが裏側の世界", "里侧的", "", "r2", "runtime", 2, "e"),
    ]
    entries = spark.createDataFrame(rows, "e bigint, source string, target string, context string, file string, scope string, batch int, document string")
    queries = spark.createDataFrame([(1, "装備とマテリア", "m"), (2, "裏側の世界で待っています", "")], "q bigint, source string, context string")
    matches, fragments = layers.lookup(queries, entries)
    got = [(r["scope"], r["batch"], r["target"], r["pos"]) for r in matches.where("q = 1").orderBy("scope", "pos").collect()]
    assert got == [("permanent", None, "装备与魔石", 1), ("runtime", 2, "新", 1)]
    found = {(r["q"], r["batch"], r["fragment"]) for r in fragments.collect()}
    assert (2, 1, "裏側の世界") in found and (2, 2, "裏側の世界") in found and not [f for f in found if f[0] == 1]
    assert {r["scope"]: (r["layers"], r["entries"]) for r in layers.layer_counts(entries).collect()} == {"permanent": (1, 2), "runtime": (3, 4)}


def test_runtime_entries(spark, tmp_path):
    from tandemtext.operators import layers, tasks

    units = spark.createDataFrame([("1", " a ", "x ", "c", "", False, False, False), ("2", "b", "y", None, "", False, True, False), ("3", "c", " ", None, "", False, False, False), ("4", "d", "z", None, "", False, False, False), ("5", "e", "", None, "", False, False, False)], "id string, source string, target string, context string, baseline string, locked boolean, source_locked boolean, preserve boolean")
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert [tuple(r)[1:] for r in layers.runtime_entries(units, asked, "d", 3).collect()] == [("a", "x", "c", "runtime", "d", 3)]
    assert sorted(r["id"] for r in tasks.writable(units, asked).collect()) == ["1", "3"]
    done = asked.withColumns({"document": F.lit("d"), "batch": F.lit(1)})
    again = layers.rebuilt(spark.createDataFrame([("d", 1), ("q", 9)], "document string, batch int"), units, done).collect()
    assert [(r["id"], r["former"]) for r in again] == [("1", True)]
    assert sorted(r["id"] for r in tasks.untranslated(units).collect()) == ["3", "5"]
    assert tuple(tasks.target_mode(units).first()) == (5, 3, "mixed")
    for name in ("x_batch_002.json", "a_batch_010.json", "note.json"):
        (tmp_path / name).write_text("{}")
    listed = layers.layer_files(spark, [str(tmp_path), str(tmp_path) + "/."]).orderBy("ord").collect()
    assert [(r["path"].rpartition("/")[2], r["batch"]) for r in listed] == [("x_batch_002.json", 2), ("a_batch_010.json", 10), ("note.json", None)]


def test_task_rows(spark):
    from tandemtext.operators import tasks

    df = spark.createDataFrame([("1", "a", "", None, "n", None, False, False, None), ("2", "b", "t", "x.y", "", "7", True, False, None), ("3", "c", "t", "x", None, None, False, False, False)], "id string, source string, baseline string, context string, note string, maxlengthchars string, source_locked boolean, preserve boolean, locked boolean").withColumn("target", F.col("baseline"))
    got = {r["id"]: (r["target"], r["locked"], r["note"]) for r in tasks.translate_rows(df).collect()}
    assert got == {"1": ("", False, "n"), "2": ("t", True, tasks.SOURCE_LOCKED), "3": ("t", True, tasks.TARGET_LOCKED)}
    assert {r["id"]: (r["locked"], r["preserve_existing"]) for r in tasks.review_rows(df).collect()} == {"1": (False, None), "2": (True, True), "3": (False, None)}
    assert {r["id"]: r["entry"] for r in tasks.analysis_json(df).collect()}["2"] == '{"id":"2","source":"b","target":"t","context":"x.y","source_locked":true,"maxlengthchars":"7"}'
    terms = spark.createDataFrame([("1", "a", "A", ""), ("1", "aa", "AA", "")], "id string, ja string, zh string, note string")
    none = spark.createDataFrame([], "q string, scope string, pos int, target string")
    one = spark.createDataFrame([("1", "runtime", 2, "w"), ("1", "runtime", 1, "v")], "q string, scope string, pos int, target string")
    said = {r["id"]: r["entry"] for r in tasks.enriched(df.select("id", "source"), terms, one, none).collect()}
    assert said["1"].index('"aa"') < said["1"].index('"ja":"a"') and '"runtime_tm_matches":[{"scope":"runtime","target":"v"}' in said["1"] and said["2"] == '{"id":"2","source":"b"}'
    info = {(r["kind"], r["name"]): (r["n"], r["share"]) for r in tasks.file_info(df.withColumns({"status": F.lit("Edited"), "has_inline_tags": F.col("id") == "1"})).collect()}
    assert info == {("all", ""): (3, "100.0%"), ("status", "Edited"): (3, "100.0%"), ("tags", ""): (1, "33.3%"), ("target", ""): (2, "66.7%"), ("context", "x"): (2, "66.7%")}
    report = spark.createDataFrame([("# t\n## gaps here\na\nb\n## next\nc",), ("none",)], "t string")
    assert [r[0] for r in report.select(tasks.section(F.col("t"), "gaps")).collect()] == ["## gaps here\na\nb", None]
    codes = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "id string, code string")
    assert [r[0] for r in tasks.problem_report(codes, 1).collect()] == ["- x: 2 (1)", "- y: 1 (3)"]
    units = spark.createDataFrame([("1", "a", "c", False), ("2", "<tag id='1' type='x' desc='y'/>", "", False), ("3", "b", "", True)], "id string, source string, context string, locked boolean")
    assert [r["id"] for r in tasks.memory_entries(units, spark.createDataFrame([("1", "t"), ("2", "t"), ("3", "t")], "id string, target string"), "f").collect()] == ["1"]


def test_pools_counted_in_blocks(spark, monkeypatch):
    """Blocks give what a full count gives, for ties, texts on several entries, segments, and where one block has more than its share."""
    monkeypatch.setattr(memory, "BLOCK_LEAST", 40)
    rng = random.Random(8)
    text = lambda: "、".join("".join(rng.choice("あいう𠮷") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4)))
    sources = [text() for _ in range(400)]
    sources += rng.choices(sources, k=300)
    entries = spark.createDataFrame(list(enumerate(sources)), "e bigint, source string")
    asked = [text() for _ in range(30)] + ["ん", "あ"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q bigint, source string")
    grams = lambda s, n: {x[i : i + n] for x in s.split("、") for i in range(len(x) - n + 1)}
    for n, limit in ((2, 20), (3, 150)):
        texts, members = memory.compact(entries, limit)
        got = sorted((r["q"], r["e"]) for r in memory.pool(queries, texts, members, n, limit).select("q", "e").collect())
        want = []
        for q, a in enumerate(asked):
            known = [(len(g), len(s), min(g), e) for e, s in enumerate(sources) if (g := grams(a, n) & grams(s, n))]
            want += [(q, x[3]) for x in sorted(known, key=lambda x: (-x[0], *x[1:]))[:limit]]
        assert got == sorted(want)


def test_a_block_that_left_out_too_much_is_asked_again():
    import numpy as np

    from tandemtext.functions import overlap

    rows = lambda ids, shared: np.array([(t, 1, shared, 5, 0, True) for t in ids], overlap.FOUND).tobytes()
    assert overlap.merged([(rows(range(3), 9), True), (rows(range(10, 13), 2), True)], 5) is None
    sure, some, room = overlap.merged([(rows(range(3), 9), False), (rows(range(10, 13), 2), True)], 5)
    assert sure["t"].tolist() == [0, 1, 2, 10, 11] and not len(some) and room == 0


def test_recall_leaves_out_what_cannot_be_similar(spark, monkeypatch):
    """Pairs whose characters keep the ratio under the threshold go before texts are joined; the matches stay those of the whole pools."""
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("あいうえおかきくけこ𠮷") for _ in range(rng.randrange(7, 16)))
    sources = [text() for _ in range(300)]
    sources += ["<b>" + s[:4] + text()[:3] + s[4:] for s in sources[:60]]
    entries = spark.createDataFrame([(i, s, "") for i, s in enumerate(sources)], "e bigint, source string, context string")
    queries = spark.createDataFrame([(i, s, "") for i, s in enumerate(sources[:20] + [text() for _ in range(20)])], "q bigint, source string, context string")
    whole = sorted(map(tuple, memory.fuzzy_matches(queries, entries).collect()))
    every = memory.recall(queries.select("q", "source"), entries)[0].count()
    monkeypatch.setattr(memory, "BLOCK_LEAST", 50)
    left = memory.recall(queries.select("q", "source"), entries, 0.6)[0].count()
    assert left < every and sorted(map(tuple, memory.fuzzy_matches(queries, entries).collect())) == whole


def test_fragments_of_large_layers_are_scored_in_blocks(spark, monkeypatch):
    """Large layers never meet the queries in a join of grams; ranks, scores and support stay those of the join."""
    rng = random.Random(11)
    part = lambda: "".join(rng.choice("アイウエオ𠮷") for _ in range(rng.randrange(3, 9)))
    parts = [part() for _ in range(40)]
    text = lambda: "、".join(rng.choice(parts) + part() for _ in range(rng.randrange(1, 4)))
    sources = [text() for _ in range(150)]
    sources += rng.choices(sources, k=80)
    entries = spark.createDataFrame([(i, s, f"t{i % 7}", rng.choice(["", None, "a", "b", "c"])) for i, s in enumerate(sources)], "e bigint, source string, target string, file string")
    queries = spark.createDataFrame(list(enumerate(sources[:5] + [text() for _ in range(15)] + ["ん"])), "q bigint, source string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    scores, found = rows(memory.idf_candidates(queries, entries, 12).select("q", "e", F.round("score", 6))), rows(memory.fragment_matches(queries, entries, limit=12))
    monkeypatch.setattr(memory, "BLOCK_LEAST", 20)
    monkeypatch.setattr(memory, "_join_scores", None)
    assert scores and rows(memory.idf_candidates(queries, entries, 12).select("q", "e", F.round("score", 6))) == scores
    assert found and rows(memory.fragment_matches(queries, entries, limit=12)) == found
    held = memory.fragment_support(spark.createDataFrame([(p,) for p in [*parts, "ア、イ", "アイ\nウエ"]], "fragment string"), entries).collect()
    files = dict(enumerate(r["file"] for r in entries.orderBy("e").collect()))
    for p in parts:
        texts = {s for s in sources if p in s}
        want = [(len(texts), len({files[i] for i, s in enumerate(sources) if s in texts and files[i]}))] if len(p) >= 4 and texts else []
        assert [(r["sources"], r["files"]) for r in held if r["fragment"] == p] == want
    assert not [r for r in held if r["fragment"] not in parts]


def test_small_layers_are_searched_without_pools(spark, monkeypatch):
    """Texts of many small layers meet the queries once, in blocks; the matches are those of each layer looked up by itself."""
    rng = random.Random(21)
    text = lambda: "、".join("".join(rng.choice("あいうえおかきくけこさしす𠮷") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 4)))
    sources = [text() for _ in range(60)] + ["", "<tag id='1' type='x' desc='y'/>", "".join(rng.choices("あいうえお", k=180)), "はい"]
    sources += [s[: len(s) // 2] + "ん" + s[len(s) // 2 + 1 :] for s in sources]
    rows = [(i, rng.choice(sources), rng.choice(["a.b", "a.c", None]), f"l{rng.randrange(40)}") for i in range(900)]
    entries = spark.createDataFrame(rows, "e bigint, source string, context string, layer string")
    asked = [(i, s, rng.choice(["a.b", None])) for i, s in enumerate([*sources[:30], *sources[60:64], *(text() for _ in range(20)), sources[0]])]
    monkeypatch.setattr(memory, "recall", None)
    monkeypatch.setattr(memory, "SPREAD", 5, raising=False)
    plain = lambda s: re.sub("<tag[^<>]*>", "", s)
    grams = lambda s: {x[i : i + 2] for x in plain(s).split("、") for i in range(len(x) - 1)}
    same = lambda a, b: sum(x == y for x, y in zip(a.split("."), b.split("."), strict=False)) if a and b else 0
    want = []
    for q, a, c in asked:
        for layer in {r[3] for r in rows} if a else ():
            hits = []
            for e, s, context, of in rows:
                if of == layer and (len(plain(a).replace("、", "")) <= 6 or grams(a) & grams(s)):
                    r = SequenceMatcher(None, plain(a), plain(s)).ratio()
                    hits += [(-round(r, 4), -same(c or "", context or ""), e)] if r >= 0.6 else []
            want += [(q, layer, h[2], k + 1) for k, h in enumerate(sorted(hits)[:3])]
    got = memory.fuzzy_matches(spark.createDataFrame(asked, "q bigint, source string, context string"), entries)
    assert len(want) > 200 and sorted((r["q"], r["layer"], r["e"], r["rank"]) for r in got.collect()) == sorted(want)


def test_fragments_of_small_layers_need_no_join_of_grams(spark, monkeypatch):
    """Whole small layers are searched in blocks; the rows are those of each layer looked up by itself with a join of grams."""
    from tandemtext.operators import layers

    rng = random.Random(31)
    part = lambda: "".join(rng.choices("アイウエオのて𠮷Ａ", [4, 4, 4, 4, 4, 1, 1, 1, 1], k=rng.randrange(2, 10)))
    parts = [part() for _ in range(25)]
    text = lambda: rng.choice(["、", "", "<tag id='1' type='x' desc='y'/>", "\n"]).join(rng.choice([rng.choice(parts), part()]) for _ in range(rng.randrange(1, 6)))
    long = "".join(rng.choices("アイウエオ", k=230))
    sources = [text() for _ in range(150)] + [long, long[20:] + "ア", "アイ", "", None]
    targets = [None, "", "x", "<tag id='1' type='x' desc='y'/>", "<tag id='2' type='z' desc='y'/>", "t"]
    place = lambda: rng.choice([("permanent", None, None), ("runtime", 1, "d"), ("runtime", 2, "d"), ("runtime", None, "d"), ("runtime", 1, None), ("runtime", 2, "a"), ("runtime", 3, "a"), (None, 3, "a"), ("other", 1, "d"), *(("runtime", i, f"f{i % 3}") for i in range(12))])
    rows = [(i, rng.choice(sources), rng.choice(targets), None, rng.choice([None, "", "a", "b"]), *place()) for i in range(500)]
    entries = spark.createDataFrame(rows, "e bigint, source string, target string, context string, file string, scope string, batch int, document string")
    asked = [(i, s, None) for i, s in enumerate([*sources[:8], long, long[:100] + "、" + long[90:], parts[0] * 3, *(text() for _ in range(25)), "アイ", sources[0], ""])]
    queries = spark.createDataFrame(asked, "q bigint, source string, context string")
    rows = lambda: sorted(map(repr, layers.fragments(queries, entries).collect()))
    with monkeypatch.context() as m:
        m.setattr(memory, "CANDIDATES", -1, raising=False)  # no layer is small
        want = rows()
    monkeypatch.setattr(memory, "_join_scores", None)
    assert len(want) > 300 and rows() == want
    monkeypatch.setattr(memory, "PIECE_MOST", 20)
    monkeypatch.setattr(memory, "PIECE_QUERIES", 9)
    assert rows() == want
