"""Words of text that writes none apart, by a dictionary.

A run of characters without white space is a graph: its places are the boundaries of its character clusters (a leading
vowel with the consonant it precedes, a base with its marks and following vowels), its edges the dictionary's words from
place to place, which one pass of an Aho-Corasick automaton (a trie with failure links) finds, and a step over each
cluster. The shortest path covers as few characters as can be by clusters alone, then has as few words as can be; of
equal paths the one whose first words are longest is taken. Neighbouring clusters that no word covers become one token.
Stretches that match ``WHOLE`` (Latin words, numbers) are tokens of their own and are never cut.

The dictionary is a table; every task gets it whole, so it must be small: DICTIONARY_BYTES is checked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

#: Thai vowels written before their consonant, and those written after it.
LEADING, FOLLOWING = "เแโใไ", "ะาำๅ"
#: The code points of Thai and of combining marks, as classes.
THAI_MARKS = "ัิ-ฺ็-๎"
CLUSTER = re.compile(rf"[{LEADING}]*[^\s{LEADING}][{FOLLOWING}{THAI_MARKS}̀-ͯ]*|[{LEADING}]+")
#: Characters that a cluster of several may hold.
JOINING = re.compile(rf"[\s{LEADING}{FOLLOWING}{THAI_MARKS}̀-ͯ]")
#: More than the words of any stretch.
OVER = 1 << 32
#: Tokens that are never cut: ASCII words with inner hyphens, numbers with separators.
WHOLE = r"[A-Za-z]+(?:-[A-Za-z]+)*|\d+(?:[.,]\d+)*"
RUNS = re.compile(r"\s+|\S+")
DICTIONARY_BYTES, REMEMBERED, SHORT = 64 << 20, 1 << 15, 64


def automaton(words: list[str]) -> ahocorasick.Automaton | None:
    """Finds words from the end of a text to its begin: it holds them, and reads the text, backwards."""
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w[::-1], len(w))
    if not words:
        return None
    a.make_automaton()
    return a


def shortest(run: str, known: ahocorasick.Automaton | None) -> list[str]:
    """Tokens of one stretch of characters, by one pass from its end."""
    n = len(run)
    if JOINING.search(run):
        place = bytearray(n + 1)
        for m in CLUSTER.finditer(run):
            place[m.end()] = 1
        place[0] = 1
    else:
        place = bytearray(b"\1") * (n + 1)
    # best: characters left over times OVER plus words; word: where the word that a place begins with ends, 0 for a step
    best, word, i, after = [0] * (n + 1), [0] * (n + 1), n, n
    for last, length in known.iter(run[::-1]) if known is not None else ():
        at = n - 1 - last
        while i > at:
            i -= 1
            if place[i]:
                best[i] = best[after] + (after - i) * OVER
                after = i
        j = at + length
        if place[at] and place[j]:
            way = best[j] + 1
            if way < best[at] or (way == best[at] and j > word[at]):
                best[at], word[at] = way, j
    tokens, i, rest = [], 0, 0
    while i < n:
        if j := word[i]:
            if rest < i:
                tokens.append(run[rest:i])
            tokens.append(run[i:j])
            i = rest = j
        else:
            i = place.find(1, i + 1)
    if rest < n:
        tokens.append(run[rest:])
    return tokens


class DictionarySegmenter:
    """Tokens of texts, without or with the white space between them."""

    def __init__(self, words: list[str], keep_blanks: bool = False, whole: str | None = WHOLE) -> None:
        known, apart = automaton(sorted(set(words) - {""})), re.compile(f"({whole})") if whole else None

        def cut(text: str) -> tuple[str, ...]:
            out: list[str] = []
            for i, part in enumerate(apart.split(text) if apart else [text]):
                if part:
                    out += [part] if i % 2 else shortest(part, known)
            return tuple(out)

        short = lru_cache(REMEMBERED)(cut)
        # only short runs come again; whole texts without blanks would fill a task's memory
        self.run, self.keep_blanks = lambda text: short(text) if len(text) <= SHORT else cut(text), keep_blanks

    def segment(self, texts: list[str]) -> list[list[str]]:
        return [[t for r in RUNS.findall(x) for t in ((r,) if r.isspace() else self.run(r)) if self.keep_blanks or not t.isspace()] for x in texts]


def dictionary(table: DataFrame, column: str = "word", most: int = DICTIONARY_BYTES) -> list[str]:
    """The distinct words of a table whose size is checked before it comes to the driver."""
    words = table.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).cast("string").alias("w")).distinct()
    size = words.agg(F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the dictionary has {size} bytes, {most} are allowed")
    return sorted(r.w for r in words.collect())


@arrow_udf(ArrayType(IntegerType()))
def ends(tokens: pa.Array) -> pa.Array:
    """Where each token ends in the text without blanks."""
    size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(size)])
    length = np.concatenate([[0], np.cumsum(pc.utf8_length(tokens.flatten()).to_numpy(zero_copy_only=False))])
    places = length[1:] - np.repeat(length[upto[:-1]], size)
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(places, pa.int32()))


def segmented(words: list[str], keep_blanks: bool = False, whole: str | None = WHOLE) -> Callable[[Column], Column]:
    """Text -> tokens, to stand in for ``functions.text.words`` (or, with blanks, ``words_and_spaces``); null gives none."""

    @pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = DictionarySegmenter(words, keep_blanks, whole)
        for texts in batches:
            yield pd.Series(model.segment(texts.fillna("").tolist()), dtype=object)

    return lambda text: cut(F.lower(text))
