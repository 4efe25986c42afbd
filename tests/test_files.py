import io
import zipfile

import pytest

from tandemtext.operators import memory
from tandemtext.sources import files, sinks
from tandemtext.streaming.layers import ENTRY, follow_layers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
XLIFF = b"""<?xml version='1.0'?><xliff xmlns='urn:oasis:names:tc:xliff:document:1.2' xmlns:mq='MQXliff'><file><body>
<trans-unit id='1' mq:status='NotStarted'><source>a<ph id='1'>&lt;mq:ch val=' '/&gt;</ph>b</source><target/></trans-unit>
<trans-unit id='2' mq:locked='locked'><source>c</source><target>d</target></trans-unit></body></file></xliff>"""


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def test_lines_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("こんにちは\n\nさようなら\n")
    (tmp_path / "b.txt").write_bytes("日本語テスト".encode("shift-jis"))
    (tmp_path / "c.bin").write_bytes(b"?")
    rows = {(r["file"], r["id"]): r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt", "3"]["source"] == "さようなら" and rows["b.txt", "1"]["source"] == "日本語テスト"
    assert rows["c.bin", None]["error"].startswith("ValueError")
    assert sinks.lines_with_targets((tmp_path / "a.txt").read_bytes(), {"3": "再见"}).decode() == "こんにちは\n\n再见\n"


def test_xlsx():
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>ja</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>5</v></c><c r="D2" t="inlineStr"><is><t>memo</t></is></c></row><row r="3"/></sheetData></worksheet>'
    parts = {
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": sheet,
        "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>剣</t></r><r><t>士</t></r></si></sst>',
    }
    assert list(files.parse_xlsx(zipped(**parts), "f")) == [{"id": "1", "source": "剣士", "target": "5", "context": "S:2", "note": "memo"}]
    out = sinks.xlsx_with_targets(zipped(**parts), {"S:2": "剑士", "S:9": "no row"})
    assert [r["target"] for r in files.parse_xlsx(out, "f")] == ["剑士"] and [r["source"] for r in files.parse_xlsx(out, "f")] == ["剣士"]


def test_docx():
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}{t}</w:p>"
    r = lambda t, look="": f"<w:r><w:rPr>{look}</w:rPr><w:t>{t}</w:t></w:r>"
    body = p(r("章"), "Heading1") + p(r("文") + r("太", "<w:b/>")) + f"<w:tbl><w:tr><w:tc>{p(r('表'))}</w:tc></w:tr></w:tbl>"
    data = zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/header1.xml": f"<w:hdr {W}>{p(r('頭'))}</w:hdr>"})
    rows = list(files.parse_docx(data, "f"))
    assert [x["id"] for x in rows] == ["body.p0", "body.p1", "body.t0.r0.c0.p0", "header.header1.p0"]
    assert rows[1]["source"] == "文<tag id='1' type='fmt' desc='⟨b⟩'/>太<tag id='2' type='/fmt' desc='⟨/b⟩'/>" and rows[1]["context"] == "章"
    new = {"body.p1": "译<tag id='1' type='fmt' desc='⟨b⟩'/>粗<tag id='2' type='/fmt' desc='⟨/b⟩'/>", "body.t0.r0.c0.p0": "格", "header.header1.p0": "头"}
    again = {x["id"]: x["source"] for x in files.parse_docx(sinks.docx_with_targets(data, new), "f")}
    assert again == {"body.p0": "章", **new}


def test_xliff_round_trip(spark):
    rows = list(files.parse_xliff(XLIFF, "f"))
    assert rows[0]["source"] == "a<tag id='1' type='br' desc='换行'/>b" and rows[1]["locked"]
    out = sinks.xliff_with_targets(XLIFF, {"1": "甲<tag id='1' type='br' desc='换行'/>乙", "2": "no"})
    again = list(files.parse_xliff(out, "f"))
    assert [x["target"] for x in again] == ["甲<tag id='1' type='br' desc='换行'/>乙", "d"] and again[0]["status"] == "Confirmed"
    with pytest.raises(ValueError):
        sinks.xliff_with_targets(XLIFF, {"1": "<tag id='9' type='br' desc='x'/>"})
    inputs = spark.createDataFrame([("f", XLIFF), ("g", b"broken")], "file string, content binary")
    results = spark.createDataFrame([("f", "1", "甲"), ("g", "1", "x")], "file string, id string, target string")
    got = {r["file"]: r for r in sinks.write_back(inputs, results, "xliff").collect()}
    assert got["f"]["error"] is None and got["g"]["content"] is None


def test_corrupt_memory_is_an_error():
    assert next(files.parse_memory(b'{"entries":[{"source":"a","target":"b"}]}', "f"))["source"] == "a"
    with pytest.raises(ValueError):
        list(files.parse_memory(b"[]", "f"))


def test_stream_of_layers(spark, tmp_path):
    new = spark.createDataFrame([(1, "s", "t", "", "f"), (2, "s", "t2", "", "f")], ENTRY)
    for part in (new.where("entry_id = 1"), new.where("entry_id = 2")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        follow_layers(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    table = sinks.VersionedTable(spark, str(tmp_path / "store"))
    assert [r["target"] for r in table.read().collect()] == ["t2"] and [r["target"] for r in table.read(0).collect()] == ["t"]
    assert memory.first_wins(table.read()).count() == 1


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    from tandemtext.streaming.layers import memory_table

    first = spark.createDataFrame([(k, f"s{k}", "t", "", "f") for k in range(1, 200)], ENTRY)
    second = spark.createDataFrame([(1, "s7", "new", "", "f"), (2, "more", "m", None, None), (3, "s8", "no", "", "g")], ENTRY)
    for part in (first, second):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        follow_layers(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    table = memory_table(spark, str(tmp_path / "store"))
    old, new = table.versions()
    changed = {b for b in new["places"] if new["places"][b] != old["places"].get(b)}
    assert 0 < len(changed) <= 3 and new["state"] == {"batch": 1, "last": 202}
    rows = {r["source"]: (r["entry_id"], r["target"]) for r in table.read().collect()}
    assert len(rows) == 200 and rows["s7"] == (7, "new") and rows["s8"] == (8, "t") and rows["more"] == (201, "m")


def test_bilingual_columns():
    from tandemtext.sources import bilingual

    rows = [(1, {0: "title"}), (2, {0: "ID", 1: "日本語A", 2: "日本語B", 3: "中文"}), (3, {0: "1", 1: "# 注", 2: "甲", 3: "A"}), (4, {0: "2", 1: "2024-01-01", 2: "乙", 3: "B"})]
    assert bilingual.header(rows) == (2, [1, 2], [3])
    assert bilingual.columns_of(rows) == (1, 3, 2) and bilingual.columns_of(rows, clean=True) == (2, 3, 2)
    assert bilingual.columns_of(rows[2:]) == (0, 1, 0) and bilingual.columns_of(rows, "B", "B") == (1, 2, 2) and bilingual.columns_of(rows, header_row=0)[2] == 0
    assert bilingual.cleanest(rows[2:], [5, 2]) == 2 and bilingual.cleanest([], []) is None


def test_bare_tags_and_written_errors(spark):
    from tandemtext.sources import sinks

    source = "<tag id='1' type='fmt' desc='⟨actor⟩'/>あ<tag id='2' type='fmt' desc='粗体开始'/>い<tag id='3' type='/fmt' desc='粗体结束'/>"
    assert sinks.markers_for_bare_tags("<actor>甲</b><what>", source) == "<tag id='1' type='fmt' desc='⟨actor⟩'/>甲<tag id='3' type='/fmt' desc='粗体结束'/><what>"
    want = spark.createDataFrame([("f", "1", source), ("f", "2", "a"), ("f", "3", source)], "file string, id string, target string")
    got = spark.createDataFrame([("f", "1", source), ("f", "2", "<ph id='1'/>"), ("f", "3", "x")], "file string, id string, target string")
    assert {(r["id"], r["error"]) for r in sinks.written_errors(want, got).collect()} == {("2", "literal_element"), ("3", "tag_sequence")}
    waiting = want.where("id = '2'").select("id")
    assert {(r["gate"], r["id"]) for r in sinks.export(want, got, waiting, "/a", "/b").collect()} == {("untranslated", "2"), ("round_trip", "2"), ("round_trip", "3")}


def test_rebuilt_memory_and_column_choice(spark):
    from tandemtext.sources import bilingual

    pairs = spark.createDataFrame([("b", 2, "s", "late", "c"), ("a", 9, " s", "first", "c"), ("a", 10, "s", "", "c"), ("a", 11, "t", "t", "")], "file string, row bigint, source string, target string, context string").selectExpr("*", "cast(null as string) as error")
    assert sorted((r["source"], r["target"], r["file"]) for r in bilingual.rebuilt_memory(pairs).collect()) == [("s", "first", "a"), ("t", "t", "a")]
    df = spark.createDataFrame([("# x", "a", None), ("b", "b", None), ("c", None, None)], "p string, q string, r string")
    assert tuple(bilingual.column_choice(df, ["p", "q", "r"]).first()) == ("q", 0, 2)


def test_merged_cells_text_boxes_and_unmarked_text():
    cell = lambda text, merge="": f"<w:tc><w:tcPr>{merge}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    body = f"<w:tbl><w:tr>{cell('a', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('ghost', '<w:vMerge/>')}</w:tr></w:tbl><w:p><w:fld><w:t>field</w:t></w:fld><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:p><w:r><w:pict><w:txbxContent><w:p/></w:txbxContent></w:pict></w:r></w:p>"
    rows = list(files.parse_docx(zipped(word__document_DOT_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>"), "x.docx"))
    assert [r.get("source") for r in rows] == ["a", "fieldbold", None] and rows[-1]["error"] == "text boxes not read: 1"


def test_rows_of_a_bare_list():
    book = zipped(
        xl__workbook_DOT_xml="<workbook xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='S' r:id='r1'/></sheets></workbook>",
        **{"xl___rels__workbook_DOT_xml_DOT_rels": ""},
    )
    import io as _io

    out = _io.BytesIO()
    with zipfile.ZipFile(_io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", old.read("xl/workbook.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='r1' Target='worksheets/sheet1.xml'/></Relationships>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><sheetData><row r='1'><c r='A1' t='inlineStr'><is><t>h</t></is></c></row><row r='2'><c r='A2' t='inlineStr'><is><t>s</t></is></c></row></sheetData></worksheet>")
    written = sinks.xlsx_with_targets(out.getvalue(), {"1": "neu"})
    assert [(r["source"], r["target"]) for r in files.parse_xlsx(written, "x.xlsx")] == [("s", "neu")]


def test_tasks_and_round_trip(spark):
    rows = spark.createDataFrame([("d", 0, 2, "2", "b", ""), ("d", 0, 1, "1", "a", "x")], "doc string, batch_no int, ord int, id string, source string, target string")
    assert sinks.task_json(rows).first()["task"] == '[{"id":"1","source":"a","target":"x"},{"id":"2","source":"b","target":""}]'
    want = spark.createDataFrame([("f", "1", "a"), ("f", "2", None), ("f", "3", "c")], "file string, id string, target string")
    got = spark.createDataFrame([("f", "1", "a"), ("f", "2", None), ("f", "3", "x")], "file string, id string, target string")
    assert [r["id"] for r in sinks.round_trip_errors(want, got).collect()] == ["3"]
