"""Visually identical text with different characters: skeletons by which texts that look alike become equal."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.folding import hash128
from tandemtext.session import durable

#: Look-alike letters, each line a prototype and the characters drawn like it.
LOOKALIKES = """
A Α А Ꭺ ᗅ
B Β В Ᏼ ᗷ
C С Ϲ Ꮯ Ⅽ
D Ꭰ Ⅾ
E Ε Е Ꭼ
F Ϝ ᖴ
G Ԍ Ꮐ
H Η Н Ꮋ
I Ι І Ӏ Ⅰ
J Ј Ꭻ
K Κ К Ꮶ K
L Ꮮ Ⅼ
M Μ М Ꮇ Ⅿ
N Ν Ꮑ
O Ο О Օ
P Ρ Р Ꮲ
Q Ԛ
R Ꭱ ᖇ
S Ѕ Ꮪ
T Τ Т Ꭲ
U Ս
V Ѵ Ꮩ Ⅴ
W Ԝ Ꮃ
X Χ Х Ⅹ
Y Υ Ү Ꮍ
Z Ζ Ꮓ
a а ɑ α
c с ϲ ⅽ
d ԁ ⅾ
e е ҽ
g ɡ
h һ
i і ι ⅰ
j ј
l ⅼ
m ⅿ
n ո
o ο о օ
p р ρ
q ԛ
s ѕ
u υ ս
v ν ѵ ⅴ
w ԝ ѡ
x х ⅹ
y у ү
エ 工
カ 力
タ 夕
ト 卜
ニ 二
ハ 八
ロ 口 囗
ヘ へ
ミ 彡
ノ 丿
オ 才
ー 一 — ― ─ ━ ⼀
土 士
日 曰
- ‐ ‑ ‒ – −
· ・ • ‧ ∙ ⋅
' ‘ ’ ʼ ′
" “ ” ″
"""
#: Simplified and other radical forms without a decomposition of their own, radical before ideograph.
RADICALS = "⺟母 ⺠民 ⻁虎 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻑長 ⻓长 ⻔门 ⻖阝 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀 ⻳龟"
#: Kinds of compatibility decomposition that keep the look; circled, raised, squared and fraction forms look different.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
#: Compatibility forms marked only <compat> that look like their parts: dots, doubled marks, radicals, ligatures.
COMPAT_RANGES = ((0x2010, 0x205F), (0x2E80, 0x2FDF), (0x3130, 0x318F), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x2160, 0x217F))
#: Blanks of about normal width; a tab and a line break can be seen.
BLANK_CATEGORY = "Zs"


def _decomposed(ch: str) -> str:
    """Full decomposition of a character, as far as it keeps the look."""
    rule = unicodedata.decomposition(ch)
    if not rule:
        return unicodedata.normalize("NFD", ch)
    kind, _, rest = rule.rpartition("> ") if rule.startswith("<") else ("", "", rule)
    if kind and f"{kind}>" not in SAME_LOOK and not (kind == "<compat" and any(a <= ord(ch) <= b for a, b in COMPAT_RANGES)):
        return ch
    return "".join(_decomposed(chr(int(x, 16))) for x in rest.split())


def _invisible(ch: str) -> bool:
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF


class Prototypes(dict):
    """Code point -> prototype text, worked out once for every character met; the size is bounded by Unicode's."""

    def __init__(self) -> None:
        super().__init__()
        self.like = {ch: line.split()[0] for line in LOOKALIKES.split("\n") if line for ch in line.split()[1:]}
        self.like |= {pair[0]: pair[1] for pair in RADICALS.split()}
        self.like |= {"゛": "゙", "゜": "゚"}

    def __missing__(self, o: int) -> str:
        ch = chr(o)
        out = "".join(self._prototype(c) for c in (_decomposed(ch) if ch not in self.like else self.like[ch]))
        self[o] = out = unicodedata.normalize("NFD", out)
        return out

    def _prototype(self, ch: str) -> str:
        if _invisible(ch):
            return ""
        if unicodedata.category(ch) == BLANK_CATEGORY:
            return " "
        return self.like.get(ch, ch)


def skeleton_text(text: str, table: Prototypes) -> str:
    """Decompose, replace every character by its prototype, decompose again."""
    return unicodedata.normalize("NFD", text.translate(table))


@F.pandas_udf(T.StringType())
def _skeleton(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    table = Prototypes()
    for s in parts:
        yield s.map(lambda t: None if t is None else skeleton_text(t, table))


def skeleton(text: Column) -> Column:
    """The skeleton of a text: equal for texts that look the same. Null stays null, an empty text empty."""
    return _skeleton(text)


def _signed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    r1, r2 = hash128(F.col("t"))
    s1, s2 = hash128(F.col("s"))
    return raw.withColumn("s", skeleton(F.col("t"))).select("id", s1.alias("s1"), s2.alias("s2"), r1.alias("r1"), r2.alias("r2"))


def lookalike_pairs(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """Pairs `left_id, right_id` (as bigint) of rows whose texts look the same but differ in their characters.

    Texts are grouped by equal skeleton. Each distinct text of a class is one row before texts of the two sides are paired,
    so a text repeated on a third of all rows meets only the texts that differ from it, and ids are expanded last: the work
    is in proportion to the rows and to the result. Joins are on hashes of 128 bits; adaptive execution splits hot ones.

    Null texts belong to no pair; an empty text looks like one of invisible characters. Repeated rows give a pair each.
    Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    a = durable(_signed(left, left_id, left_text), "skeletons")
    b = durable(_signed(right, right_id, right_text), "skeletons")
    key = ["s1", "s2"]
    texts = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).groupBy(*key, "r1", "r2").agg(F.bit_or("side").alias("side"))
    several = texts.groupBy(*key).agg(F.count("*").alias("n"), F.bit_or("side").alias("sides")).where("n > 1 and sides = 3").select(*key)
    mixed = durable(texts.join(several, key, "left_semi"), "mixed-skeletons")
    mine = mixed.where("side & 1 = 1").select(*key, F.col("r1").alias("a1"), F.col("r2").alias("a2"))
    other = mixed.where("side & 2 = 2").select(*key, F.col("r1").alias("b1"), F.col("r2").alias("b2"))
    pairs = mine.join(other, key).where("a1 <> b1 or a2 <> b2").select("a1", "a2", "b1", "b2")
    left_rows = a.select("id", F.col("r1").alias("a1"), F.col("r2").alias("a2")).withColumnRenamed("id", "left_id")
    right_rows = b.select("id", F.col("r1").alias("b1"), F.col("r2").alias("b2")).withColumnRenamed("id", "right_id")
    return pairs.join(left_rows, ["a1", "a2"]).join(right_rows, ["b1", "b2"]).select("left_id", "right_id")


def consistent_form(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Brings all texts to one form: `id, form`, the most frequent text among those that look alike, ties to the smaller text.

    Every row with an id is returned once; a null text has a null form. Counting is by distinct text first, so a hot text is
    one row per task; only texts that take another form are joined back, by 128-bit hashes.
    """
    raw = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("t")).where("id is not null")
    distinct = raw.where("t is not null").groupBy("t").agg(F.count("*").alias("n"))
    s1, s2 = hash128(skeleton(F.col("t")))
    r1, r2 = hash128(F.col("t"))
    signed = durable(distinct.select("t", "n", s1.alias("s1"), s2.alias("s2")), "text-skeletons")
    several = signed.groupBy("s1", "s2").agg(F.count("*").alias("texts"), F.max("n").alias("n")).where("texts > 1")
    mixed = durable(signed.join(several.select("s1", "s2", F.col("n").alias("most")), ["s1", "s2"]), "mixed-texts")  # few texts look like another
    top = mixed.where("n = most").groupBy("s1", "s2").agg(F.min("t").alias("form"))
    changed = durable(mixed.join(top, ["s1", "s2"]).where("t <> form").select(r1.alias("r1"), r2.alias("r2"), "form"), "changed-texts")
    solid = raw.where("t is not null").select("id", "t", r1.alias("r1"), r2.alias("r2"))
    return solid.join(changed, ["r1", "r2"], "left").select("id", F.coalesce("form", "t").alias("form")).unionByName(raw.where("t is null").select("id", F.col("t").alias("form")))
