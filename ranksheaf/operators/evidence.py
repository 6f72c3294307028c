"""Questions against the paragraphs of their own document: BM25, dense and late-interaction scores, gold marks, ranks.

A document is one row (doc_id is unique): its paragraphs, their words, the counts behind the scores and the ranks are
arrays of that row, so texts are never shuffled. What the scores count comes from ``counts``, the formulas are here. What follows by question shuffles narrow rows of ids, ranks and scores.
Only a table of at most SPREAD_BYTES is dealt out by doc_id first, so that its few row groups reach all cores. A
document is the largest group there is. Steps are kept apart by ``stage``, so that no array is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_valid_paragraph, spoken, words
from .counts import counted, products

#: Okapi BM25's constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
Tokenizer = Callable[[Column], Column]
#: A table up to this size, as the optimizer estimates it, may be read by fewer tasks than there are cores.
SPREAD_BYTES = 256 << 20


def spread(docs: DataFrame) -> DataFrame:
    """Small tables dealt out by doc_id, which what follows by question then reuses; larger ones as they are read."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition("doc_id") if size <= SPREAD_BYTES else docs


def stage(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """The columns ``keep`` of df and the made ones. The generator between keeps the optimizer from copying a column into each of its uses."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(name) for name, c in made.items())))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraph_arrays(docs: DataFrame, tokenize: Tokenizer = words, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ps (valid lines in order), ts (their words), n, and the columns ``also`` of docs."""
    lines = stage(docs, ["doc_id", *also], ps=F.filter(F.split("text", "\n"), is_valid_paragraph))
    return stage(lines, ["doc_id", *also, "ps"], ts=F.transform("ps", tokenize), n=F.size("ps").cast("long"))


def paragraphs(docs: DataFrame, tokenize: Tokenizer = words) -> DataFrame:
    """doc_id, pos (1-based), para_id, text, tokens."""
    rows = paragraph_arrays(docs, tokenize).select("doc_id", "n", F.posexplode(F.arrays_zip("ps", "ts")).alias("i", "p"))
    pos = (F.col("i") + 1).cast("long")
    return rows.select("doc_id", "n", pos.alias("pos"), F.concat(F.lit("P"), pos.cast("string")).alias("para_id"), F.col("p.ps").alias("text"), F.col("p.ts").alias("tokens"))


def questioned(docs: DataFrame, tokenize: Tokenizer = words, also: tuple[str, ...] = ()) -> DataFrame:
    """One question a document that has a word: every second of words 2 to 9 of one paragraph (its only word, if there is one); gold is where the phrase stands."""
    spoken = F.filter(F.transform("ts", lambda t, i: F.when(F.size(t) > 0, i)), lambda i: i.isNotNull())
    keep = ["doc_id", *also, "n", "ps", "ts"]
    d = stage(paragraph_arrays(docs, tokenize, also), keep, spoken=spoken).where(F.size("spoken") > 0)
    d = stage(d, keep, chosen=F.get("ts", F.get("spoken", F.pmod(F.col("doc_id"), F.size("spoken")).cast("int"))))
    d = stage(d, keep, span=span_of("chosen"))
    return stage(d, keep, q=asked(F.col("span")), phrase=F.array_join("span", " "))


def span_of(chosen: str) -> Column:
    """Words 2 to 9, or the only one."""
    return F.when(F.size(chosen) > 1, F.slice(chosen, 2, 8)).otherwise(F.col(chosen))


def asked(span: Column) -> Column:
    """Every second word."""
    return F.filter(span, lambda t, i: i % 2 == 0)


def cosine(dot: Column, norm: Column, asked_norm: Column) -> Column:
    """From a product and squared lengths; 0 where one is empty."""
    return F.coalesce(F.try_divide(dot.cast("double"), F.sqrt(norm) * F.sqrt(asked_norm)), F.lit(0.0))


def run_lengths(a: Column) -> Column:
    """How often each distinct value occurs, in the values' order."""
    ends = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))
    lengths = lambda e: F.transform(e, lambda x, k: x - F.coalesce(F.get(e, k - 1), F.lit(0)))
    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(let(F.sort_array(a), lambda s: let(ends(s), lengths)))


def ranks(scores: Column) -> Column:
    """1-based ranks of an array of scores, the largest first, of equals the earlier first."""
    order = F.sort_array(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    back = lambda o: F.sort_array(F.transform(o, lambda x, r: F.struct(x["i"].alias("i"), (r + 1).cast("long").alias("r"))))
    return F.transform(let(order, back), lambda x: x["r"])


def rounded(c: Column) -> Column:
    """Scores are ranked as rounded, so that the order of a sum decides nothing."""
    return F.round(c, 9)


def by_score(score: str, group: str = "doc_id", tie: str = "pos"):
    return F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)).cast("long")


def total(a: Column, f: Callable[[Column], Column], kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + f(x).cast(kind))


def scored(docs: DataFrame, tokenize: Tokenizer = words, late: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, ps, ts, q, n_gold and s: per paragraph pos, len, is_gold, bm25, dense (and late), rb, rd (and rl); and the columns ``also`` of docs."""
    keep = ["doc_id", *also, "n", "ps", "ts", "q"]
    n, c = F.col("n"), F.col("c")
    idf = lambda df: F.log(n - df + 0.5) - F.log(df + 0.5)
    standing = lambda j: total(c["tf"], lambda t: (F.get(t, j) > 0).cast("long"), "long")
    d = questioned(spread(docs.select("doc_id", "text", *also)), tokenize, also)
    d = stage(d, [*keep, "phrase"], c=counted(late)(F.col("ts"), F.col("q")))
    d = stage(d, [*keep, "phrase", "c"], avgdl=total(F.col("ts"), F.size, "long") / n, idf0=F.transform("q", lambda t, j: idf(standing(j))))
    # the mean over all words of the document is asked for only where a word of the question stands in most paragraphs
    sums = F.aggregate(F.transform(c["standing"], lambda k, i: F.when(k > 0, k * idf(i + 1)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    mean = sums / total(c["standing"], lambda k: k, "long")
    d = stage(d, [*keep, "phrase", "c", "avgdl", "idf0"], least=F.when(F.exists("idf0", lambda x: x < 0), EPSILON * mean))
    d = stage(d, [*keep, "phrase", "c", "avgdl"], idf=F.transform("idf0", lambda x: F.when(x < 0, F.col("least")).otherwise(x)))

    def bm25(p: Column, i: Column) -> Column:
        weigh = lambda f, w: w * f * (K1 + 1) / (f + K1 * (1 - B + B * F.size(p) / F.col("avgdl")))
        return total(F.zip_with(F.get(c["tf"], i), F.col("idf"), weigh), lambda x: x)

    def dense(p: Column, i: Column) -> Column:
        return cosine(F.get(c["dot"], i), F.get(c["norm"], i), c["asked_norm"])

    phrase = lambda p: F.contains(F.concat(F.lit(" "), F.array_join(p, " "), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    # only a paragraph with every word of the question can hold the phrase
    gold = lambda p, i: F.when(F.forall(F.get(c["tf"], i), lambda f: f > 0), phrase(p)).otherwise(False).cast("long")
    more = [("late", lambda p, i: F.get(c["late"], i))] if late else []
    each = [("bm25", lambda p, i: rounded(bm25(p, i))), ("dense", lambda p, i: rounded(dense(p, i))), *more]
    d = stage(d, keep, s=F.transform("ts", lambda p, i: F.struct((i + 1).cast("long").alias("pos"), F.size(p).cast("long").alias("len"), gold(p, i).alias("is_gold"), *(f(p, i).alias(name) for name, f in each))))
    d = stage(d, [*keep, "s"], n_gold=total(F.col("s.is_gold"), lambda x: x, "long"), **{f"r{name[0]}": ranks(F.col(f"s.{name}")) for name, _ in each})
    ranked = F.transform("s", lambda x, i: F.struct(*(x[name].alias(name) for name in ("pos", "len", "is_gold", *(name for name, _ in each))), *(F.get(f"r{name[0]}", i).alias(f"r{name[0]}") for name, _ in each)))
    return stage(d, [*keep, "n_gold"], s=ranked)


def dense_scores(docs: DataFrame) -> DataFrame:
    """doc_id and dense: that score of every paragraph of a questioned document, as ``scored`` gives it; what only the other scores and gold need is neither made nor counted."""
    d = stage(spread(docs.select("doc_id", "text")), ["doc_id"], ps=F.filter(F.split("text", "\n"), is_valid_paragraph))
    d = stage(d, ["doc_id"], ts=F.transform("ps", spoken))
    d = stage(d, ["doc_id", "ts"], said=F.filter(F.transform("ts", lambda t, i: F.when(t != "", i)), lambda i: i.isNotNull())).where(F.size("said") > 0)
    d = stage(d, ["doc_id", "ts"], chosen=F.split(F.get("ts", F.get("said", F.pmod(F.col("doc_id"), F.size("said")).cast("int"))), " "))
    d = stage(d, ["doc_id", "ts"], q=asked(span_of("chosen")))
    d = stage(d, ["doc_id"], c=products()(F.col("ts"), F.col("q")))
    c = F.col("c")
    return stage(d, ["doc_id"], dense=F.zip_with(c["dot"], c["norm"], lambda dot, norm: rounded(cosine(dot, norm, c["asked_norm"]))))


def evidence(docs: DataFrame, tokenize: Tokenizer = words, late: bool = False) -> DataFrame:
    """doc_id, pos, n, len, is_gold, n_gold, bm25, dense, rb, rd (and late, rl) for every paragraph of a questioned document."""
    return scored(docs, tokenize, late).select("doc_id", "n", "n_gold", F.inline("s"))


def methods(e: DataFrame) -> DataFrame:
    """Evidence in long form: method, doc_id, pos, is_gold, n_gold, rank."""
    rrf = e.withColumn("rrf", rounded(rrf_score("rb", "rd"))).withColumn("rr", by_score("rrf"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(r).alias("rank")) for m, r in (("dense", "rd"), ("bm25", "rb"), ("rrf", "rr")))))
    return rrf.select("doc_id", "pos", "n", "is_gold", "n_gold", "dense", each.alias("m")).select("m.method", "m.rank", "doc_id", "pos", "n", "is_gold", "n_gold", "dense")


def rrf_score(*ranks: str, k: int = 60) -> Column:
    """Reciprocal rank fusion; a list that lacks the paragraph adds nothing."""
    return rrf_of(*(F.col(r) for r in ranks), k=k)


def rrf_of(*ranks: Column, k: int = 60) -> Column:
    return sum((F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def min_max(c: str, group: str = "doc_id") -> Column:
    w = Window.partitionBy(group)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))


def weighted_score(a: str, b: str, alpha: Column | float, group: str = "doc_id") -> Column:
    """(1 - alpha) of the first and alpha of the second, each scaled to 0..1 within the question."""
    share = F.lit(alpha) if isinstance(alpha, float) else alpha
    return (1 - share) * min_max(a, group) + share * min_max(b, group)


def union_pool(e: DataFrame, n: int, first: str = "rd", second: str = "rb") -> DataFrame:
    """The first list's top n in order, then what the second's top n adds: pool_pos."""
    return ordered_union(e, n, [first, second])


def ordered_union(e: DataFrame, n: int, lists: list[str]) -> DataFrame:
    """The first list's top n in order, then what each further list's top n adds: pool_pos."""
    order = F.coalesce(*(F.when(F.col(r) <= n, i * n + F.col(r)) for i, r in enumerate(lists)))
    kept = e.withColumn("_order", order).where("_order IS NOT NULL")
    return kept.withColumn("pool_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("_order")).cast("long")).drop("_order")


def question_metrics(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """hit@1/5/20, recall@5, MRR, IoU@1 and IoU at the number of gold paragraphs, per question; rank, is_gold and n_gold are needed."""
    gold, rank = F.col("is_gold") == 1, F.col("rank")
    within = lambda k: F.count_if(gold & (rank <= k))
    hits = ranked.groupBy(*keys, "n_gold").agg(
        *(within(k).alias(f"in{k}") for k in (1, 5, 20)), F.count_if(gold & (rank <= F.col("n_gold"))).alias("ino"), F.min(F.when(gold, rank)).alias("first"), F.count_if(rank <= F.col("n_gold")).alias("shown")
    )
    return metrics_of(hits, keys)


def metrics_of(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics from in1, in5, in20 and ino (gold up to ranks 1, 5, 20 and n_gold), first (rank of the first gold one) and shown (how many ranks up to n_gold there are)."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n = F.col("n_gold")
    return hits.select(
        *keys, *((F.col(f"in{k}") > 0).cast("double").alias(f"hit{k}") for k in (1, 5, 20)), share(F.col("in5"), n).alias("recall5"),
        share(F.lit(1), F.col("first")).alias("mrr"), share(F.col("in1"), n + 1 - F.col("in1")).alias("iou1"), share(F.col("ino"), n + F.col("shown") - F.col("ino")).alias("iouok"),
    )


def document_metrics(rows: DataFrame) -> DataFrame:
    """method, doc_id and the metrics of ``question_metrics`` over ``methods``, from rows of ``scored``: within the document's row, nothing is shuffled."""
    d = stage(rows, ["doc_id", "n", "n_gold"], rd=F.col("s.rd"), rb=F.col("s.rb"), rr=ranks(F.transform("s", lambda x: rounded(rrf_of(x["rb"], x["rd"])))), marks=F.col("s.is_gold"))
    golden = lambda r: F.filter(r, lambda x, i: F.get("marks", i) == 1)
    each = F.array(*(F.struct(F.lit(m).alias("method"), golden(F.col(r)).alias("g")) for m, r in (("dense", "rd"), ("bm25", "rb"), ("rrf", "rr"))))
    d = d.select("doc_id", "n", "n_gold", F.inline(each))
    within = lambda k: F.size(F.filter("g", lambda r: r <= k)).cast("long")
    hits = d.select("method", "doc_id", "n_gold", *(within(k).alias(f"in{k}") for k in (1, 5, 20)), within(F.col("n_gold")).alias("ino"), F.array_min("g").alias("first"), F.least("n", "n_gold").alias("shown"))
    return metrics_of(hits, ["method", "doc_id"])


METRICS = ["hit1", "hit5", "hit20", "recall5", "mrr", "iou1", "iouok"]


def mean_metrics(per_question: DataFrame, keys: list[str]) -> DataFrame:
    return per_question.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))
