"""Broken source and target pairs: labelling functions for every defect, combined by an expectation-maximisation label model."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.arrays import summed
from tandemtext.functions.codepoints import codepoints
from tandemtext.functions.folding import TAG, strip_tags
from tandemtext.llm import labels
from tandemtext.llm.labels import ABSTAIN, NO, YES
from tandemtext.session import durable

#: A target sentence is boilerplate if it stands under so many different sources: a share of all pairs, but at least so many.
BOILERPLATE_SHARE, BOILERPLATE_LEAST = 1e-4, 8
DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
#: Words of translators, of inability, and of excuses that only a translator makes.
TRANSLATOR = re.compile(r"翻译|译文|译成|中文版|本段|这段|该文本|此内容|该请求|翻訳|訳せ|訳文|このテキスト|この文章|translat|this (?:text|segment|content|request)|that request|번역|перев[оё]д|traduc|tradui|übersetz", re.IGNORECASE)
UNABLE = re.compile(r"抱歉|对不起|不好意思|无法|不能|没法|恕|不予|没有足够|できません|できかね|申し訳|すみません|sorry|can ?not|can't|unable|won't|apologi|죄송|못|할 수 없|не могу|извин|no puedo|lo siento|désolé|ne peux|leider|kann nicht", re.IGNORECASE)
EXCUSE = re.compile(r"语言模型|人工智能|AI ?助手|内容政策|敏感内容|安全限制|上下文|更多信息|如有其他需要|换一段|言語モデル|AIアシスタント|ポリシー|別の文章|文脈|language model|AI assistant|content (?:policy|guideline)|guidelines|more context|assist with|help with|언어 모델|정책|문맥|языков\w+ модел", re.IGNORECASE)
MARK = re.compile(r"(?:…|\.{3}|‥|[\[（(]\s*(?:…|\.{3}|续|続|略)\s*[\]）)]?)\s*$")
DOTS = re.compile(r"(?:…|\.{3}|‥)\W*$")
LABEL = re.compile(r"^[^：:】\]>|]{0,12}[：:】\]>|]+\s*")
SENTENCES = re.compile(r"[^。！？!?\n…]*[。！？!?\n…]+[」”』）\"]*|[^。！？!?\n…]+")
BODY = re.compile(r"[^\s\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\u3000\x00-\x1f]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]{2,}")


def plain(text: str | None) -> str:
    return TAG.sub("", text or "")


def visible(text: str) -> bool:
    return any(unicodedata.category(c)[0] not in "ZC" and c not in "ㅤᅟᅠ⠀" for c in text)


class _Table(dict):
    """What str.translate() makes of each character, worked out once for every character met; bounded by Unicode's size."""

    def __init__(self, rule: Callable[[str], str | None]) -> None:
        super().__init__()
        self.rule = rule

    def __missing__(self, o: int) -> str | None:
        self[o] = out = self.rule(chr(o))
        return out


def _script(c: str) -> str:
    """r hiragana, k other kana, h ideograph, l Latin, o other letter, d digit, blank anything else."""
    o = ord(c)
    if 0x3041 <= o <= 0x309F:
        return "r"
    if 0x30A0 <= o <= 0x30FA or 0x30FD <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9D:
        return "k"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "h"
    if unicodedata.category(c)[0] == "L" and c != "ー":
        return "l" if o < 0x250 or 0xFF21 <= o <= 0xFF5A else "o"
    return "d" if c.isdigit() else " "


_LEVEL = _Table(lambda c: c if unicodedata.category(c)[0] in "LNS" else None)
_SCRIPTS = _Table(_script)


def compared(text: str) -> str:
    """Text without blanks, punctuation and invisible characters, width and letter case levelled."""
    return unicodedata.normalize("NFKC", text).casefold().translate(_LEVEL)


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCES.findall(text.strip()) if compared(s)]


def scripts(text: str) -> dict[str, int]:
    """How many letters of each script a text has."""
    kinds = text.translate(_SCRIPTS)
    return {"kana": kinds.count("r") + kinds.count("k"), "han": kinds.count("h"), "latin": kinds.count("l"), "other": kinds.count("o")}


def length_features(sentence: str) -> tuple[float, ...]:
    """What the length of a translation depends on."""
    kinds = sentence.translate(_SCRIPTS)
    return 1.0, float(kinds.count("k")), float(kinds.count("r")), float(kinds.count("h")), float(kinds.count("l") + kinds.count("o") + kinds.count("d"))


@dataclass
class Corpus:
    """Statistics of all pairs: how long a sentence's translation is, its spread, and letters that only sources have."""

    weights: tuple[float, ...]
    spread: float
    source_only: frozenset[str]

    def expected(self, sentence: str) -> float:
        return max(1.0, sum(x * w for x, w in zip(length_features(sentence), self.weights, strict=True)))


def corpus_statistics(pairs: DataFrame) -> Corpus:
    """From all pairs `s, t`: least squares on normal equations summed over all tasks, and letter counts of both sides."""
    k, top = 5, 0x24000  # the first plane, then the planes of ideographs
    size = k * k + k + 3 + 2 * top

    def usable(s: str | None, t: str | None) -> tuple[list[str], list[str]] | None:
        if not s or not t:
            return None
        a, b = sentences(plain(s)), sentences(plain(t))
        n = scripts("".join(b))
        return (a, b) if a and len(a) == len(b) and n["han"] > n["latin"] and not n["kana"] else None

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        ss, ts = batch.column("s").to_pylist(), batch.column("t").to_pylist()
        for column, at in ((ss, k * k + k + 3), (ts, k * k + k + 3 + top)):
            points, _ = codepoints([x or "" for x in column])
            place = np.where(points < 0x10000, points, points.astype(np.int64) - 0x10000)
            total[at : at + top] += np.bincount(place[(points < 0x10000) | ((points >= 0x20000) & (points < 0x34000))], minlength=top)
        rows = [(length_features(x), float(len(compared(y)))) for s, t in zip(ss, ts, strict=True) if (u := usable(s, t)) for x, y in zip(*u, strict=True)]
        if rows:
            x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            total[: k * k] += (x.T @ x).ravel()
            total[k * k : k * k + k] += x.T @ y
            total[k * k + k : k * k + k + 3] += [len(y), y.sum(), (y * y).sum()]

    total = summed(pairs, lambda: np.zeros(size), add)
    xx, xy = total[: k * k].reshape(k, k), total[k * k : k * k + k]
    n, _, yy = total[k * k + k : k * k + k + 3]
    w = np.linalg.solve(xx + 1e-3 * np.eye(k), xy) if n > 50 else np.array([0.0, 1.0, 0.4, 1.0, 1.0])
    residual = max(0.0, yy - 2 * w @ xy + w @ xx @ w) / max(n, 1)
    a, b = total[k * k + k + 3 :][:top], total[k * k + k + 3 + top :][:top]
    only = [chr(o if o < 0x10000 else o + 0x10000) for o in np.nonzero((a >= 5) & (b < 0.3 * a))[0].tolist() if 0x3400 <= o <= 0x9FFF or o >= 0x10000]
    return Corpus(tuple(map(float, w)), float(np.sqrt(residual)) if n > 50 else 3.0, frozenset(only))


class Text:
    """A text with what the labelling functions look at, each worked out once when first asked for."""

    def __init__(self, raw: str | None) -> None:
        self.raw = raw or ""

    @cached_property
    def plain(self) -> str:
        return plain(self.raw)

    @cached_property
    def compared(self) -> str:
        return compared(self.plain)

    @cached_property
    def visible(self) -> bool:
        return visible(self.plain)

    @cached_property
    def scripts(self) -> dict[str, int]:
        return scripts(self.plain)

    @cached_property
    def grams(self) -> set[str]:
        c = self.compared
        return {c[i : i + 3] for i in range(len(c) - 2)}

    @cached_property
    def rest(self) -> str:
        """Without a label in front."""
        return compared(LABEL.sub("", self.plain, count=1))

    @cached_property
    def said(self) -> bool:
        return bool(TRANSLATOR.search(self.plain))

    @cached_property
    def excuse(self) -> bool:
        return bool(EXCUSE.search(self.plain))

    @cached_property
    def unable(self) -> bool:
        return bool(UNABLE.search(self.plain))

    @cached_property
    def words(self) -> list[str]:
        return LATIN.findall(self.plain)

    @cached_property
    def levelled(self) -> tuple[str, str]:
        return self.plain.casefold(), unicodedata.normalize("NFKC", self.plain).casefold()

    @cached_property
    def marked(self) -> bool:
        return bool(MARK.search(self.plain.rstrip()))

    @cached_property
    def sentences(self) -> list[str]:
        return sentences(self.plain)

    @cached_property
    def last(self) -> int:
        return len(compared(self.sentences[-1]))

    def lengths(self, corpus: Corpus) -> list[float]:
        """What its sentences' translations are expected to take."""
        if "_lengths" not in self.__dict__:
            self._lengths = list(map(corpus.expected, self.sentences))
        return self._lengths


def votes(s: Text, t: Text, boilerplate: bool, corpus: Corpus) -> list[list[int]]:
    """The labelling functions' votes on a pair, one list for each of DEFECTS."""
    a, b = s.plain, t.plain
    ca, cb = s.compared, t.compared
    seen = t.visible
    yes_no = lambda x: YES if x else NO
    if_so = lambda x: YES if x else ABSTAIN
    empty = [yes_no(not seen), yes_no(not cb), yes_no(not BODY.search(b)), ABSTAIN if seen and not cb and ca else yes_no(not cb and bool(ca))]
    if not seen:
        return [empty, [NO] * 6, [NO] * 4, [NO] * 4, [NO] * 4]
    na, nb = s.scripts, t.scripts
    letters = max(1, sum(nb.values()))
    japanese = na["kana"] > 0 or not corpus.source_only.isdisjoint(a)
    # copy
    rest, grams = t.rest, s.grams
    held = sum(g in cb for g in grams) / len(grams) if grams else float(ca == cb)
    same = bool(ca) and (cb == ca or rest == ca)
    copy = [yes_no(japanese and same), yes_no(japanese and held >= 0.9 and len(cb) <= 1.5 * len(ca) + 12), if_so(japanese and bool(ca) and cb.endswith(ca)) if held >= 0.5 else NO, yes_no(japanese and nb["kana"] >= 0.8 * na["kana"] and held > 0.7)]
    copied = japanese and (same or held >= 0.9)
    # refusal
    said, excuse = t.said, t.excuse
    unable = (said or excuse) and t.unable
    told = (said or excuse) and (s.said or s.excuse)
    refusal = [yes_no(said and unable and not copied and not told), yes_no(excuse and (unable or said) and not copied and not told), if_so(boilerplate and not copied), NO if not (said or excuse or boilerplate) else ABSTAIN]
    refused = not copied and not told and (excuse or said) and (unable or boilerplate)
    # wrong language: the target's own words, without those that the source has, too
    found = t.words
    known = s.levelled if found else ("", "")
    words = [w for w in found if w.casefold() not in known[0] and w.casefold() not in known[1]]
    own = sum(map(len, words))
    foreign = nb["kana"] / letters > 0.1 or nb["other"] / letters > 0.1 or (own / letters > 0.5 and own >= 3)
    wrong = [
        yes_no(foreign and not copied and not refused and (japanese or na["han"] > 0)), NO if copied or refused else ABSTAIN,
        yes_no(not copied and not refused and nb["han"] / letters < 0.6 and (nb["kana"] + nb["other"] + own) > 2 and (japanese or na["han"] > 0)), NO if nb["han"] / letters > 0.8 and not nb["kana"] else if_so(foreign and not copied and not refused),
    ]
    # truncated
    chinese = not copied and not refused and not foreign and bool(ca) and ca != cb
    x, y = s.sentences, t.sentences
    mark = t.marked and not s.marked
    if foreign and not copied and not refused and x and y:  # its length says nothing, its end does
        ended, mark = b.rstrip()[-1:] in "。！？!?」”』）).\"'", mark and not DOTS.search(a.rstrip())
        cut = [ABSTAIN, ABSTAIN, YES if mark else NO if ended else ABSTAIN, ABSTAIN, NO if ended and not mark else ABSTAIN, yes_no(mark and len(y) < len(x))]
    elif not chinese or not x or not y:
        cut = [NO] * 6
    else:
        lengths = s.lengths(corpus)
        last, due = lengths[-1] - t.last, sum(lengths)
        whole = due - len(cb)
        limit = 2.6 * corpus.spread
        fewer = len(y) < len(x)
        ends = b.rstrip()[-1] in "。！？!?」”』）)…~～♪.\"'" and not mark
        stops = a.rstrip()[-1] in "。！？!?」』"
        cut = [
            yes_no(fewer or (last > limit and not ends)), yes_no(whole > limit * max(1.0, np.sqrt(len(x)))), YES if mark and (fewer or last > 1.2 * corpus.spread) else NO if ends and not fewer else ABSTAIN,
            yes_no(len(cb) < 0.78 * due and len(ca) > 6), NO if len(y) >= len(x) and last < 1.5 * corpus.spread else ABSTAIN, if_so(stops and not ends and last > limit),
        ]
    return [empty, cut, refusal, copy, wrong]


def _planted(corpus: Broadcast, told: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Votes on artificial defects of every pair, counted: nothing, the target cut short, a frequent excuse, the source again, another pair's source.

    told: targets with boilerplate; those with an excuse serve as refusals.
    """
    excuses = [x for x in map(Text, told) if x.unable and (x.said or x.excuse)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blanks = [Text("\u200b " * i) for i in range(3)]
        for b in batches:
            if not b.num_rows:
                continue
            ids, ss, ts = b.column("id").to_pylist(), list(map(Text, b.column("s").to_pylist())), list(map(Text, b.column("t").to_pylist()))
            out: Counter[tuple[str, str]] = Counter()
            for i, s, t, other in zip(ids, ss, ts, ss[1:] + ss[:1], strict=True):
                body, kept, n = t.plain.rstrip(), t.sentences, t.scripts
                made = {"empty": blanks[i % 3], "copy": s if s.scripts["kana"] else None, "wrong_language": other if other.scripts["kana"] > 5 and other.compared != s.compared else None}
                if n["han"] > n["latin"] + n["kana"] and len(kept) == len(s.sentences) and len(body) > 12:
                    made["truncated"] = Text("".join(kept[:-1]) if len(kept) > 1 and i % 2 else body[: len(body) - max(4, len(kept[-1]) * 2 // 3)])
                if excuses:
                    made["refusal"] = excuses[i % len(excuses)]
                out.update((defect, ",".join(map(str, votes(s, target, defect == "refusal", corpus.value)[DEFECTS.index(defect)]))) for defect, target in made.items() if target is not None)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], ["defect", "votes", "n"])

    return scan


def pair_defects(df: DataFrame, id_col: str, source: str, target: str) -> DataFrame:
    """Flags each defective pair with its defects: `id, defect, posterior`, one row per defect whose posterior is over its cutoff.

    For each defect several noisy functions vote yes, no or nothing. The label model of a defect learns from the counts of all
    vote patterns how much each function can be trusted, and gives a posterior per pattern; the patterns (at most 3 to the
    number of functions) are all that the driver sees. A defect's cutoff is the one with the best F1 as validated on artificial
    defects of all pairs with a source and a target, none of which is known to the label model. Labels are judged one by one, so a pair can keep several. Sentences that many sources share as targets are found by a grouped
    count, relative to the number of pairs, and joined back, so nothing that grows with the data is broadcast.

    A null or empty target is `empty`. A null or blank source has nothing to render: such a pair is never `truncated` or
    `copy`. Rows with a null id are left out; repeated rows are judged each. Other columns are ignored. Empty table: no rows.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source).cast("string").alias("s"), F.col(target).cast("string").alias("t")).where("id is not null")
    corpus = corpus_statistics(rows)
    long_enough = rows.select("id", F.explode(F.filter(F.transform(F.split(F.regexp_replace(strip_tags(F.col("t")), r"（[^（）]*）\s*$", ""), "[。！？!?.\n]"), F.trim), lambda x: F.length(x) >= 8)).alias("x"), F.xxhash64("s").alias("src"))
    said = durable(long_enough.select("id", "src", F.xxhash64("x").alias("h")), "target-sentences")
    n = rows.count()
    often = max(BOILERPLATE_LEAST, BOILERPLATE_SHARE * n)
    common = durable(said.select("h", "src").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= often).select("h"), "boilerplate")
    marked = said.join(common, "h", "left_semi").select("id").distinct().withColumn("boilerplate", F.lit(True))
    shared = df.sparkSession.sparkContext.broadcast(corpus)  # a few numbers and at most 65,536 letters

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [votes(Text(s), Text(t), bool(p), shared.value) for s, t, p in zip(*(b.column(c).to_pylist() for c in ("s", "t", "boilerplate")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array([",".join(map(str, v[k])) for v in found], pa.string()) for k in range(len(DEFECTS))]], ["id", *DEFECTS])

    joined = rows.join(marked, "id", "left").select("id", "s", "t", "boilerplate")
    cast = durable(joined.mapInArrow(vote, "id bigint, " + ", ".join(f"{d} string" for d in DEFECTS)), "votes")
    long = cast.select("id", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS])).alias("x")).select("id", "x.*")
    patterns: dict[str, list[tuple[str, int]]] = {}
    for r in long.groupBy("defect", "votes").agg(F.count("*").alias("n")).orderBy("defect", "votes").collect():
        patterns.setdefault(r["defect"], []).append((r["votes"], r["n"]))
    planted: dict[str, list[tuple[str, int]]] = {}
    refusals = said.join(common, "h", "left_semi").select("h", "id").groupBy("h").agg(F.min("id").alias("id"))  # few: each stands in a share of all pairs
    told = [r["t"] for r in refusals.join(rows.select("id", "t"), "id").groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()]
    for r in rows.where("s <> '' and t <> ''").mapInArrow(_planted(shared, told), "defect string, votes string, n bigint").groupBy("defect", "votes").agg(F.sum("n").alias("n")).orderBy("defect", "votes").collect():
        planted.setdefault(r["defect"], []).append((r["votes"], r["n"]))
    judged = []
    for defect, seen in patterns.items():
        v = np.array([[int(x) for x in p.split(",")] for p, _ in seen])
        counts = np.array([n for _, n in seen], float)
        model = labels.fit(v, counts)
        made = planted.get(defect, [])
        if made:
            cutoff = labels.validated_cutoff(model, v, counts, np.array([[int(x) for x in p.split(",")] for p, _ in made]), np.array([n for _, n in made], float))
        else:
            cutoff = model.cutoff
        judged += [(defect, p, float(q)) for (p, _), q in zip(seen, model.posterior(v), strict=True) if q >= cutoff and YES in [int(x) for x in p.split(",")]]
    kept = df.sparkSession.createDataFrame(judged, "defect string, votes string, posterior double")  # patterns, not records
    return long.join(F.broadcast(kept), ["defect", "votes"]).select("id", "defect", "posterior")
