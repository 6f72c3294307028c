"""Source divergence audit: how far each source's words are from those of every other source of its language.

Texts are split into terms and counted inside the map tasks, where a task keeps counts per (lang, source, term) and
emits them, with the number of documents that hold the term, whenever it holds more than HELD of them. The counts
meet by (lang, source, term), then by (lang, term): that row, a term with the sources it stands in and how often, is a
row of the term-major index. Terms in fewer than DOCUMENTS documents of the language are not kept.

Pairs come from Gustavson's row accumulation. The index is dealt out in blocks of terms of about POSTINGS entries.
In a block each group is a row of a sparse matrix: it walks its own terms, and each term's row of the index is
scattered into an accumulator with one place per source of the language, so no pair of postings is ever emitted; a
block gives one accumulator per group and their sum is the result. A pair of absent terms still has a share (that of
count 0), so what is scattered for a term that both groups have is the correction

    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

with p0 and q0 the shares of count 0. The rest of the sum needs no pairs: a term of one group only gives f(p, q0) or
f(p0, q), added up once for each distinct share that a group has in the block, and every term of the block gives
f(p0, q0) once.

Shares are whole billionths and f is a whole number, so sums are exact in any order. Shares are formed with Python's
unbounded integers where a 64-bit product would not hold them, and as decimal(38) in SQL; f is at most about 10**18.

Defined cases: null text, lang and source count as ''; a text without letters has no terms, but its group is there;
a language none of whose terms is kept gives its pairs the value 0 and no term rows; a language of one source gives no
pairs; very long texts are read whole; repeated rows count as often as they stand there; equal values are ranked by
the item's UTF-8 bytes; no rows give no rows; columns beside text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, durable_table

DOCUMENTS, TOP, BILLION = 3, 200, 1_000_000_000
#: Counts a map task holds before it emits them, and postings in a block of terms.
HELD, POSTINGS = 300_000, 250_000
#: Salts of the first of two top-k rounds.
SALTS = 64
PIECE = 1 << 20
#: A term is a run of bytes that are A-Z, a-z or not ASCII; A-Z are lower-cased.
TO_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def counted(held: int):
    """Rows lang, source, term, n, docs: counts of what the task has read since it last emitted."""

    def rows(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(text.as_py().translate(TO_TERMS).split())
                n.update(own)
                docs.update(own.keys())
            if sum(len(n) for n, _ in found.values()) > held:
                yield from rows(found)
                found = {}
        yield from rows(found)

    return run


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.call_function("div", (wide(n) + F.lit(1).cast("decimal(1,0)")) * F.lit(BILLION).cast("decimal(10,0)"), wide(total) + wide(terms))
    return F.lit(1).cast("long") + over


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """share() of counts n where ``total`` already holds the number of terms."""
    if len(n) and int(n.max()) >= (1 << 63) // BILLION - 1:
        return np.array([1 + BILLION * (int(a) + 1) // int(b) for a, b in zip(n, np.broadcast_to(total, n.shape), strict=True)], np.int64)
    return 1 + BILLION * (n.astype(np.int64) + 1) // total


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def row_accumulators(slots: np.ndarray, counts: np.ndarray, starts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Sums of f over the terms of one block, a row per group.

    slots and counts are the postings in term order, starts where each term's begin (and the end), totals each
    group's words plus the number of kept terms of the language.
    """
    groups, terms = len(totals), len(starts) - 1
    zero = shares(np.zeros(groups, np.int64), totals)
    p = shares(counts, totals[slots])
    term = np.repeat(np.arange(terms), np.diff(starts))
    by_group = np.argsort(slots, kind="stable")
    begin = np.searchsorted(slots[by_group], np.arange(groups + 1))
    alone = np.zeros((groups, groups), np.int64)  # [g, j]: g's own terms against j's zero; its transpose's part follows
    other = np.zeros((groups, groups), np.int64)
    out = np.zeros((groups, groups), np.int64)
    for g in range(groups):
        mine = by_group[begin[g] : begin[g + 1]]
        values, times = np.unique(p[mine], return_counts=True)
        base = gaps(zero[g], zero)
        for v, k in zip(values, times, strict=True):
            alone[g] += k * (gaps(v, zero) - base)
            other[:, g] += k * (gaps(zero, v) - gaps(zero, zero[g]))
        row = np.zeros(groups, np.int64)
        lengths = starts[term[mine] + 1] - starts[term[mine]]
        at = 0
        while at < len(mine):  # pieces of bounded size, at least one term each
            upto = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), PIECE, "right")) + at)
            own, n = mine[at:upto], lengths[at:upto]
            met = np.repeat(starts[term[own]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            peers, mine_p = slots[met], np.repeat(p[own], n)
            np.add.at(row, peers, gaps(mine_p, p[met]) - gaps(mine_p, zero[peers]) - gaps(zero[g], p[met]) + base[peers])
            at = upto
        out[g] = row + terms * base
    return out + alone + other


def block_pairs(key: tuple, index: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, slot, peer, value of one block of terms."""
    lang = groups.column("lang")[0].as_py()
    order = np.argsort(groups.column("slot").to_numpy())
    totals = groups.column("total").to_numpy()[order]
    postings = index.column("postings").combine_chunks() if index.num_rows else pa.array([], pa.list_(pa.struct([("slot", pa.int32()), ("n", pa.int64())])))
    if isinstance(postings, pa.ChunkedArray):
        postings = pa.concat_arrays(postings.chunks)
    flat = postings.flatten()
    starts = np.concatenate(([0], np.cumsum(postings.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    sums = row_accumulators(flat.field("slot").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64), starts, totals) if index.num_rows else np.zeros((len(totals),) * 2, np.int64)
    g, j = np.nonzero(~np.eye(len(totals), dtype=bool))
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "slot": pa.array(g.astype(np.int32)), "peer": pa.array(j.astype(np.int32)), "value": pa.array(sums[g, j])})


def divergence(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP, postings: int = POSTINGS, held: int = HELD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module."""
    rows = named(docs)
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = rows.select("lang", "source").distinct()
    groups = durable_table(groups.withColumn("slot", (F.row_number().over(by_name) - 1).cast("int")))
    few = lambda df: broadcast_if_small(df, [c for c in ("lang", "source", "item") if c in df.columns], broadcast_bytes)
    counts = rows.mapInArrow(counted(held), "lang string, source string, term binary, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).join(few(groups), ["lang", "source"])
    entry = F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("postings")
    index = counts.groupBy("lang", "term").agg(entry, F.sum("n").alias("all"), F.sum("docs").alias("held")).where(F.col("held") >= documents)
    index = durable_table(index.select("lang", "term", "postings", "all"))
    posted = index.select("lang", "term", "all", F.inline("postings"))
    terms = index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_words"))
    words = posted.groupBy("lang", "slot").agg(F.sum("n").alias("words"))
    zero = F.lit(0).cast("long")
    stats = groups.join(words, ["lang", "slot"], "left").join(terms, "lang", "left")
    stats = durable_table(stats.select("lang", "source", "slot", F.coalesce("words", zero).alias("words"), F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_words", zero).alias("lang_words")))

    # pairs
    blocks = -(-(index.agg(F.sum(F.size("postings"))).first()[0] or 1) // postings)
    dealt = index.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "postings")
    each = stats.select("lang", "slot", (F.col("words") + F.col("terms")).alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    partial = dealt.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInArrow(block_pairs, "lang string, slot int, peer int, value long")
    sums = partial.groupBy("lang", "slot", "peer").agg(F.sum("value").alias("value"))
    name = lambda slot, c: groups.select("lang", F.col("slot").alias(slot), F.col("source").alias(c))
    pairs = sums.join(few(name("slot", "source")), ["lang", "slot"]).join(few(name("peer", "item")), ["lang", "peer"])
    order = [F.desc("value"), "item"]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank"))

    # terms
    own = posted.join(few(stats), ["lang", "slot"])
    own = own.select("lang", "source", "term", share(F.col("n"), F.col("words"), F.col("terms")).alias("p"), share(F.col("all"), F.col("lang_words"), F.col("terms")).alias("q")).where(F.col("p") > F.col("q"))
    own = own.select("lang", "source", F.col("term").cast("string").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    for by in (["lang", "source", "_salt"], ["lang", "source"]):
        own = own.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return pairs.unionByName(own.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, coalesce(n.n, 0) AS n, coalesce(v.v, 0) AS v, v.n AS lang_n
  FROM g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) n USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY ALL) v USING (lang)),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (s.n + s.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.c + 1)) // (s.lang_n + s.v)::HUGEINT AS q
  FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 200
"""
