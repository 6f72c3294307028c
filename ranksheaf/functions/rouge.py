"""ROUGE-L: F1 over the longest common subsequence of two token lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType


def lcs_length(a: list[str], b: list[str]) -> int:
    """One bit per token of a; a whole row of the table is advanced by one addition."""
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & where.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@pandas_udf(LongType())
def _lcs(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def prefix_lcs(a: list[str], b: list[str], whole: list[int], tails: list[str | None]) -> list[int]:
    """Common subsequences of a with prefixes of b, all from one pass over b.

    The i-th prefix is the first whole[i] tokens of b and, if tails[i] is not None, one more token, which the cut left.
    """
    where: dict[str, int] = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    step = lambda row, t: ((row + (row & where.get(t, 0))) | (row - (row & where.get(t, 0)))) & full
    order = sorted(range(len(whole)), key=lambda i: whole[i])
    out, row, at = [0] * len(whole), full, 0
    for i in order:
        upto = min(whole[i], len(b))
        while at < upto:
            row = step(row, b[at])
            at += 1
        end = row if tails[i] is None else step(row, tails[i])
        out[i] = len(a) - end.bit_count()
    return out


@pandas_udf(ArrayType(LongType()))
def _prefix_lcs(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, whole, tails in rows:
        yield pd.Series([prefix_lcs(list(w), list(x), [int(y) for y in z], list(t)) for w, x, z, t in zip(a, b, whole, tails, strict=True)])


def capped(tokens: Column, text: Column, words: list[int], chars: list[int], tokenize: Callable[[Column], Column]) -> Column:
    """How each cap cuts an answer: structs unit, cap, whole (tokens left whole) and tail (a token that was cut, or null).

    tokens are those of the whole text. Word caps keep the first tokens; character caps cut the text and cut it into
    tokens anew, of which only the last can differ; cap 0 of unit 'none' keeps all.
    """
    n = F.size(tokens)
    row = lambda unit, cap, whole, tail: F.struct(F.lit(unit).alias("unit"), F.lit(cap).alias("cap"), whole.cast("int").alias("whole"), tail.alias("tail"))
    none = F.lit(None).cast("string")

    def by_chars(cap: int) -> Column:
        def of(cut: Column) -> Column:
            last, k = F.element_at(cut, -1), F.size(cut)
            torn = (k > 0) & (F.get(tokens, k - 1) != last)
            return row("c", cap, F.when(torn, k - 1).otherwise(k), F.when(torn, last).otherwise(none))

        return F.get(F.transform(F.array(tokenize(F.substring(text, 1, cap))), of), F.lit(0))

    return F.array(*(row("w", c, F.least(n, F.lit(c)), none) for c in words), *(by_chars(c) for c in chars), row("none", 0, n, none))


def capped_scores(answers: DataFrame, gold: str, found: str, text: str, keys: list[str], words: list[int], chars: list[int], tokenize: Callable[[Column], Column]) -> DataFrame:
    """keys, unit, cap, size (tokens left) and rouge_l for every cap, from one pass over each answer."""
    rows = answers.select(*keys, gold, found, capped(F.col(found), F.col(text), words, chars, tokenize).alias("_caps"))
    rows = rows.select(*keys, F.size(gold).alias("_gold"), "_caps", _prefix_lcs(F.col(gold), F.col(found), F.col("_caps.whole"), F.col("_caps.tail")).alias("_n"))
    each = rows.select(*keys, "_gold", F.explode(F.arrays_zip("_caps", "_n")).alias("x"))
    each = each.select(*keys, "_gold", "x._caps.unit", F.col("x._caps.cap").alias("cap"), (F.col("x._caps.whole") + F.col("x._caps.tail").isNotNull().cast("int")).alias("size"), F.col("x._n").alias("_common"))
    return each.select(*keys, "unit", "cap", "size", F.coalesce(F.try_divide(2.0 * F.col("_common"), (F.col("_gold") + F.col("size")).cast("double")), F.lit(0.0)).alias("rouge_l"))


def rouge_l(gold: Column, found: Column) -> Column:
    """F = 2PR / (P + R); 0 without a common token or with an empty side."""
    n = _lcs(gold, found)
    p, r = F.try_divide(n, F.size(found)), F.try_divide(n, F.size(gold))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
