from pyspark.sql import functions as F

from tandemtext.functions import text as tx
from tandemtext.functions.codepoints import fold_batch
from tandemtext.functions.folding import fold, folded
from tandemtext.functions.vectorized import break_issues, chinese_value, layout, number_values, numbers_differ, similarity


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_segments_and_grams(spark):
    assert col(spark, "ＡＢ１<tag id='1' type='br' desc='换行'/>の世界。終わり", tx.segments) == ["AB1", "の世界", "終わり"]
    assert col(spark, "あいうえ、か", lambda c: tx.ngrams(tx.segments(c), 3)) == ["あいう", "いうえ"]
    assert col(spark, "", lambda c: tx.ngrams(tx.segments(c), 2)) == []


def test_display_tags(spark):
    shown = {
        "<tag id='1' type='req' desc='⟨actor⟩'/>": "⟨actor⟩", "<tag id='2' type='fmt' desc='color结束'/>": "⟨/color⟩", "<tag id='2' type='fmt' desc='斜体结束'/>": "⟨/i⟩",
        "a<tag id='3' type='br' desc='换行'/>b": "a\nb", "<color=orange>本文</color>": "⟨color=orange⟩本文⟨/color⟩",
    }
    for raw, out in shown.items():
        assert col(spark, raw, tx.display_tags) == out


def test_brackets_and_blanks(spark):
    assert [col(spark, x, tx.balanced) for x in ("（a「b」）", "（a", "a）", "（「）」", "")] == [True, False, False, False, True]
    issue = lambda s, t: spark.createDataFrame([(s, t)], "s string, t string").select(tx.whitespace_issue(F.col("s"), F.col("t"))).first()[0]
    assert [issue("a", " b"), issue("a", "b  c"), issue("a  a", "b  c"), issue("a", "b ，"), issue("a", "b")] == [True, True, False, True, False]


def test_fold_is_the_same_everywhere(spark):
    for x in ("Ａｂ。 c　<tag id='1' type='x' desc='y'/>Ｄ！", "İx", None, "", "ＨＰ・ー～|"):
        points, at = fold_batch([x])
        assert col(spark, x, folded) == fold(x) == points.tobytes().decode("utf-32-le")[: at[1]]


def test_numbers(spark):
    assert [chinese_value(x) for x in ("十", "一百二十四", "二〇二四", "三万五千", "x")] == [10, 124, 2024, 35000, None]
    assert number_values("１２％と007", False) == ["12%", "7"]
    rows = [("第３章", "第三章", False), ("第１２３章", "第一百二十四章", True), ("１２％", "百分之十二", False), ("章", "第三章", False), ("3", "", True)]
    df = spark.createDataFrame([r[:2] for r in rows], "s string, t string")
    assert [r[0] for r in df.select(numbers_differ("s", "t")).collect()] == [r[2] for r in rows]


def test_similarity_is_asymmetric_and_bounded():
    assert (similarity("tide", "diet"), similarity("diet", "tide")) == (0.25, 0.5)
    assert similarity("同じ", "同じ") == 1.0
    assert similarity("ab", "abcdefghijkl", 0.6) == 0.0


def br(n):
    return f"<tag id='{n}' type='br' desc='换行'/>"


def test_breaks():
    source = f"a{br(1)}b{br(2)}{br(3)}c"
    assert break_issues(source, source) == []
    assert break_issues(source, f"a b{br(2)}{br(3)}c") == []  # soft breaks may go
    assert "trailing_break" in break_issues(source, f"a{br(2)}{br(3)}c{br(1)}")
    assert "break_order" in break_issues(source, f"a{br(2)}{br(3)}b{br(1)}c")
    assert "unknown_break_id" in break_issues(source, f"a{br(9)}b{br(2)}{br(3)}c")
    assert layout(f"定义{br(1)}说明{br(2)}{br(3)}后续动作") == {"source_lines": ["定义", "说明", "", "后续动作"], "soft_breaks": ["1"], "hard_breaks": [["2", "3"]], "max_consecutive": 2}
    assert layout("none") is None


def test_tags(spark):
    assert [tuple(t) for t in col(spark, "a<tag id='1' type='fmt' desc='x'/>b", tx.tags)] == [("1", "fmt", "x")]
    assert [col(spark, x, tx.malformed) for x in ("<tag id='1' type='x' desc=''/>", "<tag id='1'/>", "<tag id='1'", "ok")] == [False, True, True, False]


def test_batches_fold_as_single_texts():
    import random

    from tandemtext.functions.codepoints import fold_batch
    from tandemtext.functions.folding import fold

    rng = random.Random(8)
    texts = ["ΛΟΓΟΣ", "λογος", "ΣΑΣ. Σ", "İstanbul", "ǅ Ⅷ Ⓐ", None, "", "Straße <tag id='1' type='br' desc='x'/>K"] + ["".join(chr(rng.choice((rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x20000)))) for _ in range(30)) for _ in range(2000)]
    points, offsets = fold_batch(texts)
    assert [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(offsets, offsets[1:])] == [fold(t) for t in texts]


def test_chinese_numerals_and_breaks():
    from tandemtext.functions.vectorized import break_issues, break_lines, chinese_value

    known = {"零": 0, "十": 10, "二十": 20, "十二": 12, "一百二十四": 124, "一百零五": 105, "三千": 3000, "一万二千": 12000, "二十万": 200000, "一亿零三": 100000003, "万": 10000, "二〇二五": 2025, "两百": 200, "": None, "x": None}
    assert {k: chinese_value(k) for k in known} == known
    br = lambda *ids: "".join(f"<tag id='{i}' type='br' desc='换行'/>" for i in ids)
    source = "定义" + br(1) + "说明" + br(2, 3) + "后续动作"
    assert break_lines(source) == [{"tag_ids": ["1"], "after_line": 0, "before_line": 1, "hard": False}, {"tag_ids": ["2", "3"], "after_line": 1, "before_line": 3, "hard": True}]
    assert break_lines("a") == []
    assert break_issues(source, "甲" + br(2, 3) + "乙") == []
    assert break_issues(source, "甲" + br(1) + "乙" + br(2, 3)) == ["trailing_break"]
    assert break_issues(source, "甲" + br(2, 3) + "乙" + br(1) + "丙") == ["break_order"]
    assert break_issues(source, "甲" + br(1) + "乙" + br(1) + "丙") == ["repeated_break_id:1", "break_order", "paragraph_lost:2,3", "paragraph_count"]
    assert break_issues(source, "甲" + br(9) + "乙" + br(2, 3) + "丙", "exact") == ["unknown_break_id", "break_order", "breaks_not_exact"]
    assert break_issues(source, br(1), "free", edges=False) == [] and break_issues("a", "b") == []


def test_names(spark, tmp_path):
    import pytest

    from tandemtext.functions import names

    assert names.project_id(" a b ") == "a b" and names.free_project_id("a", "/x", {"a": "/x"}) == "a"
    assert len(names.free_project_id("a", "/x", {"a": "/y"})) == 10
    for bad in ("", ".", "a.", "a/b", "a\x01"):
        with pytest.raises(ValueError):
            names.project_id(bad)
    (tmp_path / "f").write_text("x")
    before = names.file_digests(spark, str(tmp_path)).collect()
    assert before[0]["sha256"].startswith("2d711642")
    kept = spark.createDataFrame(before)
    assert names.changed_files(kept, names.file_digests(spark, str(tmp_path))).count() == 0
    assert names.distinct_paths(spark.createDataFrame([("C:\\a\\B",), ("c:/a/./b",), ("d",)], "path string")).count() == 2
