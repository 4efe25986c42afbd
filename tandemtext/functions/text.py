"""Text functions as Spark columns; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandemtext.functions.folding import TAG_PATTERN

#: Markup, the separators between segments, full-width characters and their half-width forms.
MARKUP = r"<[^>]+>"
SEPARATORS = r"[\s\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000,.!?;:()\[\]{}「」『』、。！？…\-]+"
FULL_WIDTH = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９＂＃＄％＆＇（）＊＋，－．／：；＜＝＞？＠［＼］＾＿｀｛｜｝～"
HALF_WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Display of tag markers, bare tags, names of closing tags.
MARKER = r"<tag\s+id=['\"][^'\"]+['\"]\s+type=['\"]([^'\"]*)['\"]\s+desc=['\"]([^'\"]*)['\"]\s*/>"
BARE_TAG = r"<(?!tag\b)(/?[a-zA-Z][a-zA-Z0-9]*(?:=[^>]*)?)>"
CLOSING_NAMES = {"斜体": "i", "粗体": "b", "下划线": "u", "颜色": "color", "字号": "size"}
#: Protected tokens, numbers, addresses, brackets.
PROTECTED = (r"\$\{[^{}]+\}", r"%(?:\d+\$)?[sdif]", r"\{\d+\}", r"\\[nrt]")
NUMBER = r"(?<!\d)\d+(?:[.,]\d+)?%?"
URL_EMAIL = r"(?U)(?:https?://|ftp://|www\.)[^\s<>\"']+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "【": "】", "「": "」", "『": "』", "〈": "〉", "《": "》"}
WEAK_START = r"^(?:して|として|また|この|その|あの|を|に|が|は|の|と|へ|で|も|や)"
WEAK_END = r"(?:を|に|が|は|の|と|へ|で|も|や|て|し|い|る)$"
SPACE = r"[\s\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, MARKUP, "")


def stripped(text: Column) -> Column:
    """Without blanks at both ends; blanks are those of Unicode and the four information separators."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def half_width(text: Column) -> Column:
    """Full-width letters, digits and 31 marks to half width; the exclamation mark, the ideographic space and kana stay."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def normalized(text: Column) -> Column:
    return half_width(strip_markup(text))


def segments(text: Column) -> Column:
    """Runs of text between separators; markup separates, too."""
    bounded = half_width(F.regexp_replace(text, MARKUP, "\n"))
    return F.filter(F.split(bounded, SEPARATORS), lambda s: s != "")


def ngrams(segs: Column, n: int) -> Column:
    """The distinct runs of n characters inside each segment."""
    each = F.transform(segs, lambda s: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - F.lit(n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(each))


def display_tags(text: Column) -> Column:
    """Markers and bare tags in readable brackets; line-break markers become line breaks."""
    out = text
    ends = r"<tag\s+id=['\"][^'\"]+['\"]\s+type=['\"](?:/[^'\"]*['\"]\s+desc=['\"]{0}|[^'\"]*['\"]\s+desc=['\"]{1})['\"]\s*/>"
    for name, short in CLOSING_NAMES.items():
        out = F.regexp_replace(out, ends.replace("{0}", name + "[^'\"]{2}").replace("{1}", name + "结束"), f"⟨/{short}⟩")
    out = F.regexp_replace(out, r"<tag\s+id=['\"][^'\"]+['\"]\s+type=['\"]/[^'\"]*['\"]\s+desc=['\"]([^'\"]*?)[^'\"]{0,2}['\"]\s*/>", "⟨/$1⟩")
    out = F.regexp_replace(out, r"<tag\s+id=['\"][^'\"]+['\"]\s+type=['\"][^'\"]*['\"]\s+desc=['\"]([^'\"]*)结束['\"]\s*/>", "⟨/$1⟩")
    out = F.regexp_replace(out, r"<tag\s+id=['\"][^'\"]+['\"]\s+type=['\"][^'\"]*['\"]\s+desc=['\"]换行['\"]\s*/>", "\n")
    out = F.regexp_replace(out, r"<tag\s+id=['\"][^'\"]+['\"]\s+type=['\"][^'\"]*['\"]\s+desc=['\"](⟨[^'\"]*⟩)['\"]\s*/>", "$1")
    out = F.regexp_replace(out, MARKER, "⟨$2⟩")
    return F.regexp_replace(out, BARE_TAG, "⟨$1⟩")


def normal_text(text: Column) -> Column:
    return stripped(F.regexp_replace(display_tags(F.coalesce(text, F.lit(""))), "\r\n?", "\n"))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), TAG_PATTERN, "")


def context_affinity(a: Column, b: Column) -> Column:
    """How many dot-separated parts of two contexts are equal at the same place; 0 if either is empty."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("x"), F.split(b, r"\.").alias("y"))
    return F.when((a != "") & (b != ""), F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))).otherwise(0)


def bag(text: Column, patterns: list[str]) -> Column:
    """The tokens of all patterns as a sorted array: equal for equal multisets."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    return F.sort_array(reduce(F.concat, found))


def numbers(text: Column) -> Column:
    return bag(text, [NUMBER])


def addresses(text: Column) -> Column:
    return bag(text, [URL_EMAIL])


def protected_tokens(text: Column) -> Column:
    return bag(text, list(PROTECTED))


def has_kana(text: Column) -> Column:
    return text.rlike(r"[぀-ヿㇰ-ㇿ]")


def has_han(text: Column) -> Column:
    return text.rlike(r"[一-鿿]")


def whitespace_issue(source: Column, target: Column) -> Column:
    return (target != stripped(target)) | (target.rlike(r"[ \t]{2,}") & ~source.rlike(r"[ \t]{2,}")) | target.rlike(r"[ \t]+[，。！？；：、》）】」』]")


def balanced(text: Column) -> Column:
    """Whether brackets are closed in order: pairs without a bracket between them are taken out until nothing changes.

    A fold over the brackets with a stack of what must come next; an impossible close leaves a mark that nothing removes.
    """
    opens, closes = "".join(BRACKETS), "".join(BRACKETS.values())
    only = F.regexp_extract_all(text, F.lit("[" + "".join("\\" + c for c in opens + closes) + "]"), F.lit(0))
    step = lambda stack, c: F.when(F.instr(F.lit(opens), c) > 0, F.concat(F.translate(c, opens, closes), stack)).when(F.substring(stack, 1, 1) == c, F.substring(stack, 2, 1_000_000_000)).otherwise(F.concat(F.lit("x"), stack))
    return F.aggregate(only, F.lit(""), step) == ""


def weak_fragment(fragment: Column) -> Column:
    return (F.length(fragment) < 4) | fragment.rlike(WEAK_START) | fragment.rlike(WEAK_END)


def rendered(text: Column) -> Column:
    """Line-break markers as line breaks, other markers as separators."""
    return F.regexp_replace(F.regexp_replace(text, r"<tag\b(?=[^<>]*\btype\s*=\s*(?:'br'|\"br\"))[^<>]*/>", "\n"), TAG_PATTERN, "\u2028")


def tags(text: Column) -> Column:
    """Tag markers as `id, type, desc`, in order."""
    attribute = lambda token, name: F.regexp_extract(token, rf"\b{name}\s*=\s*(['\"])(.*?)\1", 2)
    return F.transform(F.regexp_extract_all(text, F.lit(TAG_PATTERN), F.lit(0)), lambda t: F.struct(attribute(t, "id").alias("id"), attribute(t, "type").alias("type"), attribute(t, "desc").alias("desc")))


def malformed(text: Column) -> Column:
    """A marker without id or type, or a marker that is never closed."""
    bad = F.exists(F.regexp_extract_all(text, F.lit(TAG_PATTERN), F.lit(0)), lambda t: ~(t.rlike(r"\bid\s*=\s*(['\"]).*?\1") & t.rlike(r"\btype\s*=\s*(['\"]).*?\1")))
    return bad | F.regexp_replace(text, TAG_PATTERN, "").contains("<tag")


def finding_id(rule: Column, entry: Column, payload: Column) -> Column:
    """rule:entry:first 12 hex digits of the payload's SHA-256; the payload is JSON with sorted keys."""
    return F.concat_ws(":", rule, entry, F.substring(F.sha2(payload, 256), 1, 12))
