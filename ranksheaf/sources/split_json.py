"""Large JSON files read by many tasks: the elements of the arrays of one top-level object.

Spark's text reader cuts a file at every ``}``, also across splits, so no task reads a file whole. What a piece means
depends on what stands before it: whether it begins inside a string, and how deep. A first pass over the pieces tells,
for each split, where it ends if it began outside or inside a string; a prefix over the splits (a few numbers each, on
the driver) gives every split its true beginning. The second pass then finds the elements: those that lie in one split
are emitted whole, and only those that a border cuts, at most two pieces a split, are put together afterwards. Counts
per split give each element its place in its array.

A file is an object whose members are arrays of objects (other members are passed over); elements of arrays deeper
down are parts of their element. Compressed files are one split. Files without elements give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r'"((?:[^"\\]|\\(?:.|\Z))*)("|\Z)|[{}\[\]]', re.S)
REST = re.compile(r'(?:[^"\\]|\\(?:.|\Z))*("|\Z)', re.S)
ENDS = "file string, at long, inside boolean, ends_inside boolean, closed int, opened string"
FOUND = "file string, at long, n int, segment int, key string, begins boolean, ends boolean, text string"


def tokens(piece: str, inside: bool) -> Iterator[tuple[int, str, str | None]]:
    """(end, mark, string) of each bracket, brace and string of a piece; mark is '"' for a string that ends here and '…' for one that does not."""
    at = 0
    if inside:
        m = REST.match(piece)
        yield m.end(), '"' if m[1] else "…", None
        at = m.end()
    for m in TOKEN.finditer(piece, at):
        yield m.end(), m[0] if m[2] is None else '"' if m[2] else "…", m[1]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, at (where the split begins) and value, in the file's order within a split; each value lost the brace that ended it."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split ends, whether it began outside or inside a string: inside or not, how many it closed of what was open before, what it left open."""
    seen: dict[tuple[str, int], list[list]] = {}
    for b in batches:
        for file, at, value in zip(*(b.column(c).to_pylist() for c in ("file", "at", "value")), strict=True):
            for state in seen.setdefault((file, at), [[False, 0, []], [True, 0, []]]):
                for _, mark, _ in tokens(value + "}", state[0]):
                    state[0] = mark == "…"
                    if mark in "{[":
                        state[2].append(mark)
                    elif mark in "}]":
                        if state[2]:
                            state[2].pop()
                        else:
                            state[1] += 1
    rows = [(file, at, bool(i), s[0], s[1], "".join(s[2])) for (file, at), states in seen.items() for i, s in enumerate(states)]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in ENDS.split(", ")])


def beginnings(ends: list) -> dict[tuple[str, int], tuple[bool, str]]:
    """file, at -> (begins inside a string, what is open there), from the rows of split_ends."""
    by, out = {(r.file, r.at, r.inside): r for r in ends}, {}
    inside, stack, last = False, "", None
    for file, at in sorted({(r.file, r.at) for r in ends}):
        if file != last:
            inside, stack, last = False, "", file
        out[file, at] = (inside, stack)
        r = by[file, at, inside]
        inside, stack = r.ends_inside, stack[: max(0, len(stack) - r.closed)] + r.opened
    return out


def elements_of(begin: dict[tuple[str, int], tuple[bool, str]]):
    """Elements and parts of elements in each split, numbered, with the array's name where the split holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        inside, stack, n, segment, key, name, open_, parts = False, "", 0, 0, None, None, False, []

        def close(ended: bool) -> None:
            nonlocal n, open_, parts
            if parts:
                rows.append((*now, n, segment, key, open_, ended, "".join(parts)))
                n += 1
            open_, parts = False, []

        for b in batches:
            for file, at, value in zip(*(b.column(c).to_pylist() for c in ("file", "at", "value")), strict=True):
                if now != (file, at):
                    close(False)
                    now, (inside, stack) = (file, at), begin[file, at]
                    n, segment, key, name = 0, 0, None, None
                if not stack and (n or segment or parts or now[1]) and "{" not in value:
                    continue  # what follows the object
                piece, start = value + "}", 0
                for end, mark, string in tokens(piece, inside):
                    inside = mark == "…"
                    if mark in "{[":
                        stack += mark
                        if stack == "{[":
                            segment, key = segment + 1, name
                        elif stack == "{[{":
                            start, open_ = end - 1, True
                    elif mark in "}]":
                        stack = stack[:-1]
                        if stack == "{[" and mark == "}":
                            parts.append(piece[start:end])
                            close(True)
                            start = end
                    elif mark == '"' and stack == "{" and string is not None:
                        name = string
                if stack.startswith("{[{"):
                    parts.append(piece[start:])
            if rows:
                yield as_batch(rows)
                rows = []
        close(False)
        if rows:
            yield as_batch(rows)

    return run


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, array (its name), ord (from 0) and json of every element."""
    rows = pieces(spark, path)
    begin = beginnings(rows.mapInArrow(split_ends, ENDS).collect())  # two rows a split
    found = rows.mapInArrow(elements_of(begin), FOUND)
    order = Window.partitionBy("file").orderBy("at", "segment")
    # one row a split and array: the array's name and how many elements begin before
    counts = found.groupBy("file", "at", "segment").agg(F.first("key", ignorenulls=True).alias("key"), F.count_if("begins").alias("_c"))
    counts = counts.withColumn("array", F.last("key", ignorenulls=True).over(order))
    before = F.sum("_c").over(Window.partitionBy("file", "array").orderBy("at", "segment")) - F.col("_c")
    firsts = Window.partitionBy("file", "at", "segment").orderBy("n")
    counts = counts.select("file", "at", "segment", "array", before.alias("_before"))
    whole = found.where("begins AND ends")
    cut = found.where("NOT (begins AND ends)")
    chain = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("at", "n"))
    joined = cut.withColumn("_chain", chain).groupBy("file", "_chain").agg(F.array_sort(F.collect_list(F.struct("at", "n", "segment", "text"))).alias("p"))
    head = F.get("p", F.lit(0))
    joined = joined.select("file", head["at"].alias("at"), head["n"].alias("n"), head["segment"].alias("segment"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    every = whole.select("file", "at", "n", "segment", "text").unionByName(joined)
    # places within a split and array, from its first number; a split holds at most a block of the file
    every = every.withColumn("_i", F.row_number().over(firsts) - 1)
    return every.join(counts, ["file", "at", "segment"]).select("file", "array", (F.col("_before") + F.col("_i")).cast("long").alias("ord"), F.col("text").alias("json"))
