"""Parsing of model answers: citation tags, tag removal, reasoning blocks, two-line answers, picked numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_digits, strip

#: The citation tag, the answer format and reasoning marks.
TAG = r"\[อ้างอิง[:\s]+([0-9,\s]+)\]"
ANY_TAG = r"\s*\[อ้างอิง[^\]]*\]"
THINK = r"(?s)<think>.*?</think>"
CHANNEL, OPEN_CHANNEL, SPECIAL = r"(?s)<\|channel>.*?<channel\|>", r"(?s)<\|channel>.*$", r"<\|?[a-zA-Z_]+\|?>"
ANSWER_LINE = r"คำตอบ\s*[:：]\s*([^\n]*)"
SOURCE_LINE = r"ย่อหน้าที่ใช้\s*[:：]\s*([^\n]*)"


def _numbers(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), F.lit(1)), lambda n: n.try_cast("int")), lambda n: n.isNotNull())


def _indices(numbers: Column, n: Column) -> Column:
    """1-based numbers in range as 0-based indices."""
    return F.transform(F.filter(numbers, lambda i: (i >= 1) & (i <= n)), lambda i: i - 1)


def cited(answer: Column, n: Column) -> Column:
    """Indices of all tags, in order, each once; the first paragraph if none is valid."""
    found = F.array_distinct(_indices(F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(TAG), F.lit(1)), _numbers)), n))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0)))


def cited_first(answer: Column, n: Column) -> Column:
    """Indices of the first tag only, repeats kept."""
    found = _indices(_numbers(F.regexp_extract(answer, TAG, 1)), n)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0)))


def without_tags(answer: Column) -> Column:
    return strip(F.regexp_replace(answer, ANY_TAG, ""))


def before_last_tag(answer: Column) -> Column:
    return strip(F.when(F.contains(answer, F.lit("[อ้างอิง")), F.regexp_extract(answer, r"(?s)^(.*)\[อ้างอิง", 1)).otherwise(answer))


def raw_tag(answer: Column) -> Column:
    return F.regexp_extract(answer, ANY_TAG, 0)


def has_citation(answer: Column) -> Column:
    return answer.rlike(TAG)


def without_thoughts(answer: Column) -> Column:
    """Closed reasoning blocks go; of an unclosed one only what follows the last end mark counts."""
    closed = F.regexp_replace(answer, THINK, "")
    return strip(F.regexp_replace(closed, r"(?s)^.*</think>", ""))


def without_channels(answer: Column) -> Column:
    """Thoughts between channel marks go, an unclosed channel with all that follows, and special tokens left over."""
    for pattern in (CHANNEL, OPEN_CHANNEL, SPECIAL):
        answer = F.regexp_replace(answer, pattern, "")
    return strip(answer)


def two_lines(answer: Column, n: Column) -> tuple[Column, Column]:
    """(text of the answer line, indices of the source line); an absent line is empty."""
    return strip(F.regexp_extract(answer, ANSWER_LINE, 1)), F.array_distinct(_indices(_numbers(fold_digits(F.regexp_extract(answer, SOURCE_LINE, 1))), n))


def picked(answer: Column, n: Column) -> Column:
    """The first number, if it is within 1..n."""
    first = F.regexp_extract(fold_digits(answer), r"([0-9]+)", 1).try_cast("int")
    return F.when((first >= 1) & (first <= n), first)


def answer_or_fallback(answer: Column, first_paragraph: Column, question: Column) -> Column:
    return F.coalesce(F.nullif(answer, F.lit("")), F.nullif(first_paragraph, F.lit("")), question)
