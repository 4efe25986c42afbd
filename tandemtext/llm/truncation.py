"""Text cut off by field limits: a classifier trained on intact texts and on artificial cuts of them."""

from __future__ import annotations

import random
import re
import unicodedata
import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.llm import logistic
from tandemtext.session import durable

#: Marks that stand for a rest, ends of sentences, and pairs of quotes and brackets.
MARKS = re.compile(r"\s*(?:[\[［(（]\s*(?:…+|\.{3,}|‥+|続き?く?|续|下略|略|truncated|cut|more|cont(?:inued|\.)?)\s*[\]］)）]?|…+|‥+|\.{3,}|～+続く|>>+|→)\s*$", re.IGNORECASE)
SENTENCE_ENDS = "。！？!?.．｡…‼⁉⁇"
PAIRS = {"「": "」", "『": "』", "“": "”", "‘": "’", "（": "）", "(": ")", "[": "]", "［": "］", "【": "】", "《": "》", "〈": "〉", "«": "»"}
CLOSERS = "".join(PAIRS.values()) + "\"'"
ENTITY = re.compile(r"&#?[0-9A-Za-z]{0,8}$")
WHOLE_TAG = re.compile(r"<tag\b[^<>]*/>$")
PARTIAL_TAG = re.compile(r"<[a-z/]?[^<>]*$")


def kind(ch: str) -> str:
    """A character's class, or itself where it is punctuation or a symbol."""
    o = ord(ch)
    if 0x3041 <= o <= 0x309F:
        return "hira"
    if 0x30A0 <= o <= 0x30FF and ch != "・":
        return "kata"
    if 0x3400 <= o <= 0x9FFF or 0x20000 <= o:
        return "han"
    c = unicodedata.category(ch)
    return {"Lu": "upper", "Ll": "lower", "Nd": "digit", "Zs": "blank", "Cc": "control"}.get(c, ch if c[0] in "PSC" else c)


def open_quotes(line: str) -> str:
    """Opening quotes and brackets of a line that are not closed; a straight quote is open if their number is odd."""
    stack: list[str] = []
    for ch in line:
        if ch in PAIRS:
            stack.append(PAIRS[ch])
        elif stack and ch == stack[-1]:
            stack.pop()
    return "".join(stack) + ('"' if line.count('"') % 2 else "")


def shape(line: str) -> str:
    """A line with runs of letters of a script, digits and blanks as one sign each."""
    out: list[str] = []
    for ch in line:
        k = kind(ch)
        k = {"hira": "h", "kata": "K", "han": "H", "upper": "A", "lower": "a", "digit": "9", "blank": " "}.get(k, k)
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


#: A word, or up to two characters, right before the end of a sentence.
SENTENCE_TAIL = re.compile(r"([A-Za-z]+|[^\sA-Za-z]{1,2})[。！？.!?]")
#: A last line of at most so many characters and without a sentence end may be a signature, a date, an end mark, a list item.
SHORT_LINE = 28


@dataclass(frozen=True)
class Closings:
    """What the whole corpus closes with, each found in at least a given share of it.

    words: before the ends of sentences; lines, heads and tails: short last lines without a sentence end (digits levelled), the
    first three and the last two characters of such lines.
    """

    words: frozenset[str] = frozenset()
    lines: frozenset[str] = frozenset()
    heads: frozenset[str] = frozenset()
    tails: frozenset[str] = frozenset()


def closings(df: DataFrame, text: str, share: float = 2e-4, word_share: float = 4e-5, least: int = 3) -> Closings:
    """Counted over all texts. A relative cutoff bounds each set (5,000 lines, heads, tails, 25,000 words) at any size of the corpus.

    Each batch of texts is counted before the shuffle; what the driver gets is bounded by the shares.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for t in b.column(0).to_pylist():
                seen["all", ""] += 1
                seen.update(("word", w.lower()) for w in SENTENCE_TAIL.findall(t))
                body = bare_end(t)
                line = body[body.rfind("\n") + 1 :]
                if 0 < len(line) <= SHORT_LINE and not any(c in SENTENCE_ENDS for c in line):
                    seen.update(zip(("line", "head", "tail"), levelled(line), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([x for _, x in seen]), pa.array(list(seen.values()), pa.int64())], ["kind", "x", "n"])

    counted = df.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, "kind string, x string, n bigint").groupBy("kind", "x").agg(F.sum("n").alias("n"))
    counted = durable(counted, "closings")
    totals = {r["kind"]: r["n"] for r in counted.where("kind in ('all', 'word')").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    cutoff = F.when(F.col("kind") == "word", max(least, word_share * totals.get("word", 0))).otherwise(max(least, share * totals.get("all", 0)))
    sets: dict[str, set[str]] = {"word": set(), "line": set(), "head": set(), "tail": set()}
    for r in counted.where((F.col("kind") != "all") & (F.col("n") >= cutoff)).collect():
        sets[r["kind"]].add(r["x"])
    return Closings(*(frozenset(sets[k]) for k in ("word", "line", "head", "tail")))


def bare_end(text: str) -> str:
    """The text without blanks and invisible characters at its end."""
    return text.rstrip().rstrip("\ufeff\u200b\x00").rstrip()


def levelled(line: str) -> tuple[str, str, str]:
    """A line with digits and letter case levelled, its head and its tail."""
    level = re.sub("[0-9]", "0", line).lower()
    return level, level[:3], level[-2:]


def closing_word(body: str) -> str:
    """The last word of a text, or its last pair of characters."""
    m = re.search(r"[A-Za-z]+$", body)
    return m.group().lower() if m else body[-2:]


def features(text: str, limits: frozenset[int], closing: Closings) -> list[str]:
    """What the end of a text looks like: closing characters, marks, open quotes, tags and entities, last line, length to a limit."""
    t = bare_end(text)
    if not t:
        return ["blank"]
    mark = MARKS.search(t)
    body = t[: mark.start()] if mark and mark.start() else t
    m = re.sub(r"\s+", "", t[len(body) :])[:6] if mark else ""
    line = t[t.rfind("\n") + 1 :]
    bare = body[body.rfind("\n") + 1 :]
    last = kind(body[-1])
    inside = open_quotes(re.sub(r"<[^<>]*>", "", bare))
    ended = body[-1] in SENTENCE_ENDS or (body[-1] in CLOSERS and not inside)
    tag = PARTIAL_TAG.search(t)
    partial = bool(tag and (tag.group().startswith(("<tag", "<t", "</")) or len(tag.group()) == 1))
    entity = ENTITY.search(t)
    lengths = {len(text), len(t), len(body), len(text.encode("utf-8", "surrogatepass"))}
    short, limit, closes = len(line) <= SHORT_LINE, bool(lengths & limits), closing_word(body) in closing.words
    ends = sum(c in SENTENCE_ENDS for c in line)
    out = [
        f"last={last}", f"mark={m}", f"mark={m}|last={last}", f"ended={ended}|mark={bool(m)}", f"open={inside[-1:]}|ended={ended}", f"open={bool(inside)}",
        f"tag={partial}|whole={bool(WHOLE_TAG.search(t))}", f"entity={bool(entity)}", f"cut={t[-1] in '�' or 0xD800 <= ord(t[-1]) < 0xE000}", f"limit={limit}", f"closes={closes}|mark={bool(m)}|limit={limit}|ended={ended}", f"closes={closes}|mark={m}|latin={last in ('lower', 'upper')}",
        f"limit={limit}|ended={ended}|mark={bool(m)}", f"end2={body[-2:]}", f"kinds={'/'.join(map(kind, body[-3:]))}",
        f"short={short}|ends={min(ends, 2)}|ended={ended}", f"first={line[:1] if kind(line[0]) == line[0] else kind(line[0])}|short={short}|ends={min(ends, 1)}|last={last}",
    ]
    if short and not ends:
        out += [f"shape={shape(line)}", f"start={line[:2]}", f"start3={line[:3]}", f"close={line[-2:]}", f"bullet={line[:2] in ('・', '* ', '- ') or line[:1] in '・•※#＃■◆'}"]
        known = tuple(x in held for x, held in zip(levelled(line), (closing.lines, closing.heads, closing.tails), strict=True))
        out += [f"known={known}", f"known={known}|above={line == t or t[: len(t) - len(line)].rstrip()[-1:] in SENTENCE_ENDS + CLOSERS + '>'}"]
        words, before = line.lower().split(), t[: len(t) - len(line)].rstrip()
        above = not before or before[-1] in SENTENCE_ENDS + CLOSERS + ">"
        tail = line.split()[-1]
        label = bool(re.match(r"[^\s:：]{1,10}[:：]", line))
        out.append(f"sign={min(len(words), 4)}|capital={tail[:1].isupper()}|label={label}|bullet={line[0] in '・•※*-#＃■◆'}|above={above}|latin={last in ('lower', 'upper')}")
        out.append(f"capital={tail[:1].isupper()}|words={min(len(words), 4)}|latin={last in ('lower', 'upper')}")
        out += [f"whole={line.lower()}"] + ([f"word={words[0]}|{words[-1]}"] if words and len(words) <= 4 else [])
    return out


def artificial_cut(text: str, limits: list[int], closing: Closings, rng: random.Random) -> str | None:
    """The text cut somewhere before its end, with a mark or a broken piece now and then; None if the cut ends a whole sentence."""
    if len(text) < 20:
        return None
    fitting = [x for x in limits if 10 < x < len(text)]
    at = rng.choice(fitting) if fitting and rng.random() < 0.4 else rng.randrange(10, len(text))
    how = rng.random()
    if how < 0.16:
        begin = next((i for i in range(at, len(text)) if text[i] in "」”』\"" and i > 10), None)
        if begin and open_quotes(text[text.rfind("\n", 0, begin) + 1 : begin]):
            return text[:begin]
    cut = text[:at].rstrip()
    if not cut or cut[-1] in SENTENCE_ENDS + CLOSERS + ">" or text[at : at + 1].strip() == "" or PARTIAL_TAG.search(cut):
        return None
    line = cut[cut.rfind("\n") + 1 :]
    if len(line) < 4 or not any(x in text[len(cut) - len(line) :][: len(line) + 200] for x in SENTENCE_ENDS):
        return None
    if how < 0.24:
        return cut + "�"
    if how < 0.36:
        tag = f"<tag id='{rng.randrange(1, 900)}' type='{'x' * rng.randrange(2, 9)}' desc='{'x' * rng.randrange(2, 16)}'/>"
        return cut + tag[: rng.randrange(1, len(tag))]
    if how < 0.44:
        whole = rng.choice(["&amp;", "&lt;", "&quot;", "&#12;", "&#8230;", "&gt;", "&nbsp;"])
        return cut + whole[: rng.randrange(2, len(whole))]
    if how < 0.66:  # a field that marks its cuts mostly cuts at a limit
        if fitting:
            cut = text[: rng.choice(fitting)].rstrip() if rng.random() < 0.75 else cut
        if cut[-1] in SENTENCE_ENDS + CLOSERS + ">" or (len(cut) not in fitting and closing_word(cut) in closing.words):
            return None
        return cut + rng.choice(["…", "...", " [...]", "……", "（続", "（续", "[…]", "(...)", " …", "（続く", "...[truncated]", "（略"])
    return text[:at]


@dataclass
class TruncationModel:
    """Weights, what the corpus gave, and what was reached on texts held out from the fit.

    held_out_recall: share of artificial cuts found by a model that saw nothing of their text. held_out_share: share of real texts
    that such a model finds truncated. sampled: texts of the fit.
    """

    weights: np.ndarray
    limits: frozenset[int]
    closing: Closings
    held_out_recall: float
    held_out_share: float
    sampled: int = 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = [logistic.hashed(features(t or "", self.limits, self.closing)) for t in texts]
        return np.where([bool(t and t.strip()) for t in texts], logistic.scores(rows, self.weights), 0.0)


def field_limits(df: DataFrame, text: str) -> frozenset[int]:
    """Lengths in code points or UTF-8 bytes that far more texts have than the lengths next to them; counted over all texts.

    All of them are returned, whatever their length; only their significance bounds their number.
    """
    bare = F.length(F.regexp_replace(F.col(text), r"\s*(?:[\[［(（]?(?:…+|\.{3,}|続く?|续)[\]］)）]?)\s*$", ""))
    both = df.select(F.explode(F.array_distinct(F.array(F.length(text), F.octet_length(text), bare))).alias("n")).where("n > 0")
    counts = both.groupBy("n").agg(F.count("*").alias("c")).withColumn("b", F.floor(F.col("n") / 16))
    near = counts.groupBy("b").agg(F.sum("c").alias("s"), F.max("c").alias("m")).select("b", ((F.col("s") - F.col("m")) / 15).alias("mean"))
    spikes = counts.join(near, "b").where("c >= 5 and c >= mean + 6 * sqrt(mean) + 4").select("n")
    return frozenset(r["n"] for r in spikes.collect())


#: Kinds of training rows: a text as it is, a part of it up to a line's end, an artificial cut of it.
REAL, INNER, CUT = 0, 1, 2


def _examples(limits: frozenset[int], closing: Closings, lines: int, cuts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashed features of each sampled text, of some of its parts that end with a line, and of artificial cuts; random by the text itself."""
    ordered = sorted(limits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, rows = [], [], []
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                rng = random.Random(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")))
                ends = [m.start() for m in re.finditer("\n", t) if m.start() > 20 and t[m.start() :].strip()]
                parts = [(REAL, t)] + [(INNER, t[:e]) for e in rng.sample(ends, min(lines, len(ends)))]
                parts += [(CUT, c) for _ in range(cuts) if (c := artificial_cut(t, ordered, closing, rng))]
                for kind, part in parts:
                    ids.append(i)
                    kinds.append(kind)
                    rows.append(logistic.hashed(features(part, limits, closing)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["i", "kind", "f"])

    return scan


def fit(df: DataFrame, id_col: str, text: str, sample: int = 12_000, rounds: int = 3, lines: int = 3, enough: int = 2_000) -> TruncationModel:
    """Fits the model on at most about `sample` texts, chosen by a hash of their id; limits and closings are counted over all texts.

    Intact texts are unknown at first: every sampled text counts as intact, its artificial cuts as truncated. In each round a
    model fitted on one half of the sample judges the other half and the reverse; texts found truncated are left out of the next
    round and of the last fit. Parts of the texts up to the end of a line count as intact, too. The fewer texts there are, the
    more cuts are made of each, 24,000 in all, so that the fit is alike at every size. Features are made by the executors;
    the driver gets numbers, not texts, at most 2 * sample * (1 + lines + 20) short lists. With fewer than `enough`
    texts rare closings cannot be learned, and a warning says so.
    """
    known = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    limits, closing = field_limits(known, "t"), closings(known, "t")
    n = known.count()
    cuts = min(20, max(2, 24_000 // max(1, min(n, sample))))
    chosen = known.where(F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1_000_000)) < int(min(1.0, sample / max(n, 1)) * 1_000_000)).where(F.col("t").rlike(r"(?U)\S"))
    chosen = durable(chosen, "cut-sample")
    if chosen.count() > 2 * sample:  # only where many rows share an id
        chosen = chosen.orderBy("i", F.xxhash64("t")).limit(2 * sample)
    made = chosen.mapInArrow(_examples(limits, closing, lines, cuts), "i bigint, kind int, f array<int>").toArrow()
    w, recall, share, texts = np.zeros(1 << logistic.BITS), 0.0, 0.0, 0
    if made.num_rows:
        every = sorted(zip(*(made.column(c).to_pylist() for c in ("i", "kind", "f")), strict=True), key=lambda r: (r[0] is not None, r))
        rows, kind = [r[2] for r in every], np.array([r[1] for r in every])
        of = np.unique([-(2**62) if r[0] is None else r[0] for r in every], return_inverse=True)[1]
        weight = np.array([cuts / 2, cuts / 4, 1.0])[kind]
        half = np.arange(of.max() + 1) % 2
        intact = np.ones(len(rows), bool)  # of the real texts; parts and cuts go with their text

        def learned(use: np.ndarray) -> np.ndarray:
            at = np.nonzero(use & intact)[0]
            return logistic.fit([rows[k] for k in at], (kind[at] == CUT).astype(float), weight[at])

        for _ in range(rounds):
            out = np.zeros(len(rows))
            for h in (0, 1):
                mine = np.nonzero(half[of] == h)[0]
                out[mine] = logistic.scores([rows[k] for k in mine], learned(half[of] != h))
            cut_text = np.zeros(of.max() + 1, bool)
            cut_text[of[(kind == REAL) & (out >= 0.5)]] = True
            intact = ~cut_text[of]
        w = learned(np.ones(len(rows), bool))
        texts = int((kind == REAL).sum())
        share = float((out[kind == REAL] >= 0.5).mean())
        recall = float((out[(kind == CUT) & intact] >= 0.5).mean()) if ((kind == CUT) & intact).any() else 0.0
        if texts < enough:
            warnings.warn(f"truncation: fitted on {texts} texts, fewer than {enough}; rare closings may count as cut", stacklevel=2)
    return TruncationModel(w, limits, closing, recall, share, texts)


def truncated(df: DataFrame, id_col: str, text: str, source: str, model: TruncationModel | None = None) -> DataFrame:
    """Scores every record: `id, source, score, truncated`.

    Null, empty and blank texts score 0. Sources stay as they are, null included. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    model = model or fit(df, id_col, text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** 18 weights: 2 MB, whatever the data

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(s), pa.array(s >= 0.5)], ["id", "source", "score", "truncated"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("t"))
    return rows.mapInArrow(scan, "id bigint, source string, score double, truncated boolean")


def rates(scored: DataFrame) -> DataFrame:
    """How often each source truncates: `source, docs, truncated_docs, rate`; partial counts come before the shuffle."""
    return scored.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("truncated").alias("truncated_docs")).withColumn("rate", F.col("truncated_docs") / F.col("docs"))
