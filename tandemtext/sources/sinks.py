"""Sinks: results back into documents, tasks as JSON, versioned tables with an atomic commit."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions import text as tx
from tandemtext.sources.files import REL, SHEET, WORD, _column, _local, decoded

_MARKER = re.compile(r"<tag id='([^']*)' type='([^']*)' desc='([^']*)'/>")
_BARE = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*(?:=[^>]*)?)>")


def lines_with_targets(data: bytes, targets: dict[str, str]) -> bytes:
    """A text file with lines replaced by number; untouched lines stay as they are, indents and line ends too."""
    out = []
    for i, line in enumerate(decoded(data).split("\n"), 1):
        new = targets.get(str(i))
        body = line.strip()
        out.append(line.replace(body, new, 1) if new is not None and body else line)
    return "\n".join(out).encode()


def xliff_with_targets(data: bytes, targets: dict[str, str], status: str = "Confirmed") -> bytes:
    """An XLIFF file with targets set; locked units stay, inline elements come back from the source's."""
    for event in re.findall(rb'xmlns(?::(\w+))?="([^"]+)"', data):
        ET.register_namespace(event[0].decode(), event[1].decode())
    root = ET.fromstring(data)
    for unit in root.iter():
        own = {_local(k): (k, v) for k, v in unit.attrib.items()}
        if _local(unit.tag) != "trans-unit" or own.get("id", ("", ""))[1] not in targets:
            continue
        if own.get("locked", ("", ""))[1] == "locked" or own.get("translate", ("", ""))[1] == "no":
            continue
        source = next(x for x in unit if _local(x.tag) == "source")
        known = {x.get("id", "") + ("_ept" if _local(x.tag) == "ept" else ""): x for x in source if _local(x.tag) in ("ph", "bpt", "ept")}
        target = next((x for x in unit if _local(x.tag) == "target"), None)
        if target is None:
            target = ET.Element(source.tag[: -len("source")] + "target")
            unit.insert(list(unit).index(source) + 1, target)
        tail = target.tail
        for x in list(target):
            target.remove(x)
        text, at, last = targets[own["id"][1]], 0, None
        for m in [*_MARKER.finditer(text), None]:
            piece = text[at : m.start() if m else len(text)]
            if last is None:
                target.text = piece
            else:
                last.tail = piece
            if m is None:
                break
            if m[1] not in known:
                raise ValueError(f"unit {own['id'][1]}: no inline element {m[1]} in the source")
            last = ET.SubElement(target, known[m[1]].tag, dict(known[m[1]].attrib))
            last.text = known[m[1]].text
            at = m.end()
        target.tail = tail
        if "status" in own:
            unit.set(own["status"][0], status)
    return ET.tostring(root, encoding="utf-8", xml_declaration=True, short_empty_elements=False)


def xlsx_with_targets(data: bytes, targets: dict[str, str], target: str = "B") -> bytes:
    """A workbook with target cells set; keys are `sheet:row`. Everything else in the file, macros too, is copied as it is.

    A key that is a number alone, as in a bare list of results, means the first sheet's row after it.
    """
    ET.register_namespace("", SHEET[1:-1])
    old, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(old.read("xl/_rels/workbook.xml.rels"))}
    parts = {}
    for sheet in ET.fromstring(old.read("xl/workbook.xml")).iter(SHEET + "sheet"):
        part = links[sheet.get(REL + "id")]
        parts[part if part.startswith("xl/") else f"xl/{part}"] = sheet.get("name")
    first = next(iter(parts.values()), "")
    targets = {f"{first}:{int(k) + 1}" if k.isdigit() else k: v for k, v in targets.items()}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            content = old.read(name)
            if name in parts:
                root = ET.fromstring(content)
                for row in root.iter(SHEET + "row"):
                    text = targets.get(f"{parts[name]}:{row.get('r')}")
                    if text is None:
                        continue
                    ref, at = f"{target}{row.get('r')}", _column(target)
                    cells = {c.get("r"): c for c in row.findall(SHEET + "c")}
                    cell = cells.get(ref)
                    if cell is None:
                        cell = ET.Element(SHEET + "c", {"r": ref})
                        row.insert(sum(_column(r) < at for r in cells), cell)
                    for x in list(cell):
                        cell.remove(x)
                    cell.set("t", "inlineStr")
                    ET.SubElement(ET.SubElement(cell, SHEET + "is"), SHEET + "t").text = text
                content = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            new.writestr(old.getinfo(name), content)
    return out.getvalue()


def docx_with_targets(data: bytes, targets: dict[str, str]) -> bytes:
    """A word-processor file with the runs of the given paragraphs rebuilt; markers switch bold, italic and underline."""
    for prefix, uri in set(re.findall(rb'xmlns:(\w+)="([^"]+)"', b"".join(zipfile.ZipFile(io.BytesIO(data)).read(n) for n in zipfile.ZipFile(io.BytesIO(data)).namelist() if n.startswith("word/") and n.endswith(".xml")))):
        ET.register_namespace(prefix.decode(), uri.decode())
    old, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()

    def fill(paragraph: ET.Element, text: str) -> None:
        for x in [x for x in paragraph if x.tag != WORD + "pPr"]:
            paragraph.remove(x)
        look, at = [], 0
        for m in [*_MARKER.finditer(text), None]:
            if piece := text[at : m.start() if m else len(text)]:
                run = ET.SubElement(paragraph, WORD + "r")
                style = ET.SubElement(run, WORD + "rPr")
                for k in look:
                    ET.SubElement(style, WORD + k, {WORD + "val": "single"} if k == "u" else {})
                ET.SubElement(run, WORD + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = piece
            if m:
                name, at = m[3].strip("⟨⟩/"), m.end()
                look = [k for k in look if k != name] if m[2].startswith("/") else [*look, name] if name in ("b", "i", "u") else look

    def walk(parent: ET.Element, path: str) -> None:
        p = t = 0
        for x in parent:
            if x.tag == WORD + "p":
                if f"{path}.p{p}" in targets:
                    fill(x, targets[f"{path}.p{p}"])
                p += 1
            elif x.tag == WORD + "tbl":
                for r, row in enumerate(x.findall(WORD + "tr")):
                    for c, cell in enumerate(row.findall(WORD + "tc")):
                        walk(cell, f"{path}.t{t}.r{r}.c{c}")
                t += 1

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            content = old.read(name)
            if m := re.fullmatch(r"word/(document|(?:header|footer)\d*)\.xml", name):
                root = ET.fromstring(content)
                walk(*((root.find(WORD + "body"), "body") if m[1] == "document" else (root, f"{re.match('[a-z]+', m[1]).group()}.{m[1]}")))
                content = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            new.writestr(old.getinfo(name), content)
    return out.getvalue()


WRITERS = {"xlsx": xlsx_with_targets, "docx": docx_with_targets, "lines": lines_with_targets, "xliff": xliff_with_targets}


def write_back(files: DataFrame, results: DataFrame, kind: str) -> DataFrame:
    """New contents of files `file, content` with results `file, id, target`: `file, content, error`; one task per file, files side by side."""

    def build(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        try:
            content, error = WRITERS[kind](bytes(left["content"].iloc[0]), dict(zip(right["id"], right["target"], strict=True))), None
        except Exception as e:  # noqa: BLE001 - one bad file must not end the job
            content, error = None, f"{type(e).__name__}: {e}"
        return pd.DataFrame({"file": [key[0]], "content": [content], "error": [error]}) if len(left) else pd.DataFrame({"file": [], "content": [], "error": []})

    return files.groupBy("file").cogroup(results.groupBy("file")).applyInPandas(build, "file string, content binary, error string")


#: Names by which a closing tag may be written, with the word its description has.
CLOSE_ALIASES = {"color": "color", "颜色": "color", "i": "斜体", "斜体": "斜体", "b": "粗体", "粗体": "粗体", "u": "下划线", "下划线": "下划线", "size": "字号", "字号": "字号"}
FORMAT_TYPES = ("fmt", "/fmt", "fmt-open", "fmt-close")


def markers_for_bare_tags(target: str, source: str) -> str:
    """Bare tags of a target as the markers of the source that are described so, or that close what they name; others stay."""
    known = [(m[2], m[3], m[0]) for m in _MARKER.finditer(source) if m[2] in FORMAT_TYPES and m[3]]
    shown = {desc: whole for _, desc, whole in known}
    ends = {desc[:-2]: whole for kind, desc, whole in known if kind in ("/fmt", "fmt-close") and desc.endswith("结束")}
    closing = {alias: ends[word] for alias, word in CLOSE_ALIASES.items() if word in ends}

    def marker(m: re.Match) -> str:
        own = shown.get(f"⟨{m[1]}⟩")
        return own or (closing.get(m[1][1:]) if m[1].startswith("/") else None) or m[0]

    return _BARE.sub(marker, target)


@F.pandas_udf(T.StringType())
def bare_to_markers(target: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else markers_for_bare_tags(t, s or "") for t, s in zip(target, source, strict=True)])


def written_errors(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """What is wrong with written targets, read again: `file, id, error`.

    expected and parsed are `file, id, target`. The sequences of tag ids must be equal, no inline element may stand in a text as
    letters, and every unit must be there.
    """
    ids = lambda c: F.transform(tx.tags(F.coalesce(F.col(c), F.lit(""))), lambda t: t["id"])
    both = expected.select("file", "id", F.col("target").alias("want")).join(parsed.select("file", "id", F.coalesce("target", F.lit("")).alias("got"), F.lit(True).alias("there")), ["file", "id"], "left")
    error = F.when(F.col("there").isNull(), "missing").when(ids("want") != ids("got"), "tag_sequence").when(F.col("got").rlike("<(?:ph|bpt|ept) "), "literal_element")
    return both.select("file", "id", error.alias("error")).where("error is not null")


def export(expected: DataFrame, parsed: DataFrame, waiting: DataFrame, source_path: str, target_path: str) -> DataFrame:
    """Gates before a final export, as `gate, id` of what fails: units that are untranslated, texts that differ after reading them again without markers.

    Writing over the source is an error.
    """
    if source_path.rstrip("/") == target_path.rstrip("/"):
        raise ValueError("the export would overwrite its source")
    plain = lambda c: tx.plain(F.col(c))
    differ = expected.select("file", "id", plain("target").alias("want")).join(parsed.select("file", "id", plain("target").alias("got")), ["file", "id"], "left").where(~F.col("want").eqNullSafe(F.col("got")))
    return waiting.select(F.lit("untranslated").alias("gate"), F.col("id").cast("string").alias("id")).unionByName(differ.select(F.lit("round_trip").alias("gate"), F.col("id").cast("string").alias("id")))


def round_trip_errors(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """Units whose written target differs from the expected one: `file, id`."""
    same = F.col("e.target").eqNullSafe(F.col("p.target"))
    return expected.alias("e").join(parsed.alias("p"), ["file", "id"], "left").where(~same).select("file", "id")


def task_json(rows: DataFrame, batch: str = "batch_no") -> DataFrame:
    """One JSON task per document and batch, entries in order: `doc, batch_no, task`."""
    entries = F.array_sort(F.collect_list(F.struct("ord", F.struct("id", "source", "target").alias("entry"))))
    return rows.groupBy("doc", batch).agg(F.to_json(F.transform(entries, lambda x: x["entry"])).alias("task"))


class VersionedTable:
    """Versions of a table in one folder; a version counts once its pointer is written, which is the last step of a commit."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def commit(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data-{name}")
        at = len(self.versions())
        self.spark.createDataFrame([(json.dumps({"version": at, "data": name}),)], "value string").coalesce(1).write.text(f"{self.path}/commit-{at:08d}")
        return name

    def versions(self) -> list[dict]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder) or not any(s.getPath().getName().startswith("commit-") for s in fs.listStatus(folder)):
            return []
        return sorted((json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/commit-*").collect()), key=lambda v: v["version"])

    def read(self, version: int = -1) -> DataFrame:
        known = self.versions()[version]
        places = [f"data-{name}/bucket={b}" for b, name in known["places"].items()] if "places" in known else [f"data-{known['data']}"]
        return self.spark.read.parquet(*[f"{self.path}/{place}" for place in places])


class BucketedTable(VersionedTable):
    """A versioned table in buckets by key: a commit writes the buckets it touches, a version is the newest writing of each bucket.

    The number of buckets is fixed by the first commit; the manifest has one entry a bucket.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64) -> None:
        super().__init__(spark, path)
        self.key = key
        known = self.versions()
        self.buckets = known[-1]["buckets"] if known else buckets

    def bucket(self) -> Column:
        """The bucket of a row by its key columns, outer blanks aside."""
        return F.pmod(F.xxhash64(*[tx.stripped(F.coalesce(F.col(c), F.lit(""))) for c in self.key]), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        return sorted(r["b"] for r in df.select(self.bucket().alias("b")).distinct().collect())

    def last(self) -> dict:
        return versions[-1] if (versions := self.versions()) else {"places": {}, "state": {}}

    def read_buckets(self, buckets: list[int] | None = None, schema: str | None = None) -> DataFrame | None:
        """The rows of the given buckets (all without); None where none of them has been written."""
        places = [f"{self.path}/data-{name}/bucket={b}" for b, name in sorted(self.last()["places"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*places) if places else None

    def commit_buckets(self, df: DataFrame, touched: list[int], state: dict) -> None:
        """Writes the touched buckets anew; `state` goes with the version. A bucket that has become empty stays as an empty place."""
        name, before = uuid.uuid4().hex, self.last()
        df.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data-{name}")
        places = {**before["places"], **{str(b): name for b in touched}}
        at = len(self.versions())
        self.spark.createDataFrame([(json.dumps({"version": at, "buckets": self.buckets, "places": places, "state": state}),)], "value string").coalesce(1).write.text(f"{self.path}/commit-{at:08d}")
