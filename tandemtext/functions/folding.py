"""Folding of text for comparison: markers, white space, punctuation and letter case removed."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An inline tag marker.
TAG_PATTERN = r"<tag\b[^<>]*/>"
TAG = re.compile(TAG_PATTERN)
#: What folding removes, in Java's and in Python's dialect.
FOLD_JAVA = TAG_PATTERN + r"|[\p{IsWhite_Space}\p{P}]+"
FOLD_PYTHON = regex.compile(TAG_PATTERN + r"|[\p{White_Space}\p{P}]+")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG_PATTERN, "")


def folded(text: Column) -> Column:
    """Text without tag markers, Unicode white space and punctuation, in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), FOLD_JAVA, ""))


def fold(text: str | None) -> str:
    """The same as folded(), for Python code that already runs on batches."""
    return FOLD_PYTHON.sub("", text or "").lower()


def trimmed(text: Column) -> Column:
    """Text without Unicode white space at both ends."""
    return F.regexp_replace(text, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same columns, for keys that must not collide over billions of rows."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols, F.lit(len(cols)))
