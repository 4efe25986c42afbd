"""Document sources: line text, spreadsheets, word-processor files, XLIFF, memory JSON. Whole files, one row per segment.

Files are read with the binaryFile source, so listing, globbing and distribution are Spark's; each file is parsed inside the
task that holds it. A file that cannot be read gives one row with `error` instead of ending the job.
"""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried, and the formats by suffix.
ENCODINGS = ("utf-8", "utf-8-sig", "shift-jis", "cp932", "gbk")
FORMATS = {"txt": "lines", "csv": "lines", "tsv": "lines", "xlsx": "xlsx", "xlsm": "xlsx", "docx": "docx", "mqxliff": "xliff", "xlf": "xliff", "xliff": "xliff"}
SCHEMA = "file string, ord bigint, id string, source string, target string, context string, note string, locked boolean, status string, maxlengthchars string, error string"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

Row = dict[str, object]


def decoded(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding")


def parse_lines(data: bytes, name: str) -> Iterator[Row]:
    """Non-blank lines; the id is the line's number, blank lines count."""
    for i, line in enumerate(decoded(data).split("\n"), 1):
        if text := line.strip():
            yield {"id": str(i), "source": text, "target": "", "context": f"{name}:L{i}"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref.upper()).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> Iterator[tuple[str, list[tuple[int, dict[int, str]]]]]:
    """Each worksheet's name and rows: number and cells by column; only the parts needed are unpacked."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(SHEET + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(SHEET + "si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(SHEET + "sheet"):
            part = targets[sheet.get(REL + "id")].lstrip("/")
            rows = []
            for k, row in enumerate(ET.fromstring(z.read(part if part.startswith("xl/") else f"xl/{part}")).iter(SHEET + "row"), 1):
                cells = {}
                for j, c in enumerate(row.iter(SHEET + "c")):
                    value = c.find(SHEET + "v")
                    text = "".join(t.text or "" for t in c.iter(SHEET + "t")) if c.get("t") == "inlineStr" else value.text or "" if value is not None else ""
                    text = shared[int(text)] if c.get("t") == "s" and text else text
                    if text.strip():
                        cells[_column(c.get("r")) if c.get("r") else j] = text.strip()
                rows.append((int(row.get("r", k)), cells))
            yield sheet.get("name"), rows


def parse_xlsx(data: bytes, name: str, source: str = "A", target: str = "B", header_row: int = 1, sheet: str | None = None) -> Iterator[Row]:
    """Rows below the header with a source cell; the other cells make the note. One sheet (the first unless named), or all with `*`."""
    s, t, n = _column(source), _column(target), 0
    for k, (title, rows) in enumerate(sheets(data)):
        if sheet != "*" and (title != sheet if sheet else k > 0):
            continue
        for number, cells in rows:
            if number > header_row and s in cells:
                n += 1
                yield {"id": str(n), "source": cells[s], "target": cells.get(t, ""), "context": f"{title}:{number}", "note": " | ".join(v for c, v in sorted(cells.items()) if c not in (s, t))}


def _run_text(paragraph: ET.Element) -> str:
    """A paragraph's text with markers around bold, italic and underlined runs; the plain text where the runs do not hold all of it."""
    out, n = [], 0
    for run in paragraph.iter(WORD + "r"):
        text = "".join("\n" if x.tag == WORD + "br" else "\t" if x.tag == WORD + "tab" else x.text or "" for x in run if x.tag in (WORD + "t", WORD + "br", WORD + "tab"))
        look = run.find(WORD + "rPr")
        marks = [m for m in ("b", "i", "u") if look is not None and (e := look.find(WORD + m)) is not None and e.get(WORD + "val", "1") not in ("0", "false", "none")]
        if not text:
            continue
        for m in marks:
            n += 1
            out.append(f"<tag id='{n}' type='fmt' desc='⟨{m}⟩'/>")
        out.append(text)
        for m in reversed(marks):
            n += 1
            out.append(f"<tag id='{n}' type='/fmt' desc='⟨/{m}⟩'/>")
    plain, marked = "".join(e.text or "" for e in paragraph.iter(WORD + "t")), "".join(out)
    return marked if re.sub(r"<tag\b[^<>]*/>|[\n\t]", "", marked) == re.sub(r"[\n\t]", "", plain) else plain


def parse_docx(data: bytes, name: str) -> Iterator[Row]:
    """Paragraphs of body, tables (nested ones, too), headers and footers; the context is the stack of headings above.

    A cell that goes on with a merged one above it is no cell of its own. Text boxes are not read; a row without text says how many there are.
    """
    stack: list[str] = []

    def walk(parent: ET.Element, path: str) -> Iterator[Row]:
        p = t = 0
        for x in parent:
            if x.tag == WORD + "p":
                plain = "".join(e.text or "" for e in x.iter(WORD + "t")).strip()
                style = x.find(f"{WORD}pPr/{WORD}pStyle")
                level = re.match(r"(?i)heading\s*(\d)", style.get(WORD + "val", "") if style is not None else "")
                if level:
                    stack[int(level.group(1)) - 1 :] = [plain]
                if plain:
                    yield {"id": f"{path}.p{p}", "source": _run_text(x), "target": "", "context": " > ".join(stack)}
                p += 1
            elif x.tag == WORD + "tbl":
                for r, row in enumerate(x.findall(WORD + "tr")):
                    for c, cell in enumerate(row.findall(WORD + "tc")):
                        merged = cell.find(f"{WORD}tcPr/{WORD}vMerge")
                        if merged is None or merged.get(WORD + "val") == "restart":
                            yield from walk(cell, f"{path}.t{t}.r{r}.c{c}")
                t += 1

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        document = ET.fromstring(z.read("word/document.xml"))
        yield from walk(document.find(WORD + "body"), "body")
        if boxes := sum(1 for _ in document.iter(WORD + "txbxContent")):
            yield {"ord": -1, "error": f"text boxes not read: {boxes}"}
        for part in sorted(n for n in z.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n)):
            stack.clear()
            kind = "header" if "header" in part else "footer"
            yield from walk(ET.fromstring(z.read(part)), f"{kind}.{part[5:-4]}")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


#: What format codes are called; others close something or keep their name.
FORMAT_NAMES = {
    "<color.strong/>": "强调色开始", "<color/>": "颜色结束", "<b/>": "粗体开始", "</b>": "粗体结束", "<i/>": "斜体开始", "</i>": "斜体结束", "<u/>": "下划线开始", "</u>": "下划线结束",
    "<color.attention/>": "警示色开始", "<color.sub/>": "副色开始", "<color.weak/>": "弱色开始", "<size.large/>": "大字号开始", "<size/>": "字号结束",
}
NO_FORMAT = "格式标签"


def format_name(code: str) -> str:
    """What a format code is called in a marker's description."""
    code = code.strip()
    closed = re.fullmatch(r"</(.*?)>?", code, re.DOTALL)
    return NO_FORMAT if not code else FORMAT_NAMES.get(code) or (f"{closed[1]}结束" if closed else code.translate(str.maketrans("<>", "⟨⟩")))


def escaped(text: str) -> str:
    """A description as it can stand in a marker."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("'", "&apos;")


def inline_text(node: ET.Element | None) -> str:
    """Mixed content with inline elements as tag markers, in order."""
    if node is None:
        return ""
    out = [node.text or ""]
    for x in node:
        kind, ident, inner = _local(x.tag), x.get("id", ""), "".join(x.itertext())
        value = re.search(r"(?:val|displaytext)=['\"]([^'\"]*)['\"]", inner)
        raw = html.unescape(value.group(1) if value else inner.strip())
        desc, name = re.sub(r"['<>]", "", raw), re.sub("['<>]", "", format_name(raw))
        name = name if name in FORMAT_NAMES.values() or name.endswith("结束") else f"⟨{desc.strip('⟨⟩')}⟩"
        if kind == "ph":
            marks = (("<mq:ch", "br", "换行"), ("<mq:rxt-req", "req", f"⟨{desc.strip('⟨⟩')}⟩"), ("<mq:rxt", "/fmt" if desc.lstrip("⟨").startswith("/") or name.endswith("结束") else "fmt", name))
            typ, shown = next(((t, d) for m, t, d in marks if inner.lstrip().startswith(m)), ("unknown", desc))
        elif kind in ("bpt", "ept"):
            typ, shown, ident = ("fmt-open", f"⟨{desc}⟩", ident) if kind == "bpt" else ("fmt-close", f"⟨/{desc.lstrip('/')}⟩", f"{ident}_ept")
        else:
            out.append("".join(x.itertext()) + (x.tail or ""))
            continue
        out.append(f"<tag id='{ident}' type='{typ}' desc='{shown}'/>" + (x.tail or ""))
    return "".join(out)


def parse_xliff(data: bytes, name: str) -> Iterator[Row]:
    """Every trans-unit with its status, lock, first context and note and length limit."""
    for unit in ET.fromstring(data).iter():
        if _local(unit.tag) != "trans-unit":
            continue
        child = {}
        for x in unit.iter():
            child.setdefault(_local(x.tag), x)
        own = {_local(k): v for k, v in unit.attrib.items()}
        text = lambda k: (child[k].text or "").strip() if k in child else ""  # noqa: E731, B023
        yield {
            "id": own.get("id", ""), "source": inline_text(child.get("source")), "target": inline_text(child.get("target")), "context": text("context"), "note": text("note"),
            "locked": own.get("locked") == "locked" or own.get("translate") == "no", "status": own.get("status", "NotStarted"), "maxlengthchars": own.get("maxlengthchars"),
        }


def parse_memory(data: bytes, name: str) -> Iterator[Row]:
    """Entries of a memory in JSON; anything but an object with a list of entries is an error, not an empty memory."""
    whole = json.loads(decoded(data))
    if not isinstance(whole, dict) or not isinstance(whole.get("entries"), list):
        raise ValueError("not a memory: no list of entries")
    for i, e in enumerate(whole["entries"]):
        yield {"id": str(i), "source": e.get("source", ""), "target": e.get("target", ""), "context": e.get("context", ""), "note": e.get("file", "")}


PARSERS: dict[str, Callable[..., Iterator[Row]]] = {"lines": parse_lines, "xlsx": parse_xlsx, "docx": parse_docx, "xliff": parse_xliff, "memory": parse_memory}


def detect_format(path: str) -> str:
    suffix = path.rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown format: {suffix}")
    return FORMATS[suffix]


def read_documents(spark: SparkSession, path: str, glob: str | None = None, kind: str | None = None, **options: object) -> DataFrame:
    """Segments of the files under a path, with an ordinal in each file; the format goes by suffix unless `kind` is given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.split()[1]]) for f in SCHEMA.split(", ")])
        for b in batches:
            for where, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                name, rows = where.rpartition("/")[2], []
                try:
                    for i, r in enumerate(PARSERS[kind or detect_format(where)](content, name, **options)):
                        rows.append({"file": name, "ord": i, "locked": False, **r})
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job
                    rows.append({"file": name, "ord": -1, "error": f"{type(e).__name__}: {e}"})
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows[a : a + 10_000]], schema=schema)

    return files.mapInArrow(parse, SCHEMA)


def glossary(rows: DataFrame) -> DataFrame:
    """A glossary read as a spreadsheet: `term_ord, ja, zh, note`, longest terms first in matching."""
    return rows.where("error is null and source <> ''").select(F.col("ord").alias("term_ord"), F.col("source").alias("ja"), F.col("target").alias("zh"), "note")
