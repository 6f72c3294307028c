"""Pluggable models: embedders, scorers and generators as iterator UDFs, one load a Python worker.

The built-in ones are deterministic stand-ins for tests and dry runs; their output is no model's result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import citations


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, questions: list[str], paragraphs: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class MultiEmbedder(Protocol):
    """One vector a token."""

    def embed_tokens(self, texts: list[str]) -> list[np.ndarray]: ...


class Segmenter(Protocol):
    """Words of a language that writes none apart."""

    def segment(self, texts: list[str]) -> list[list[str]]: ...


class YesNoScorer(Protocol):
    """Logits of the answers yes and no, a row a prompt."""

    def logits(self, prompts: list[str]) -> np.ndarray: ...


class HashMultiEmbedder:
    """A token as its place among so many dimensions."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed_tokens(self, texts: list[str]) -> list[np.ndarray]:
        import zlib

        eye = np.eye(self.dimensions, dtype=np.float32)
        return [eye[[zlib.crc32(w.encode()) % self.dimensions for w in t.lower().split()]].reshape(-1, self.dimensions) for t in texts]


class HashEmbedder:
    """Bag of hashed words, of length one."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.dimensions] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OverlapScorer:
    """Share of the question's words that the paragraph holds."""

    def score(self, questions: list[str], paragraphs: list[str]) -> list[float]:
        pairs = ((set(q.lower().split()), set(p.lower().split())) for q, p in zip(questions, paragraphs, strict=True))
        return [len(q & p) / len(q) if q else 0.0 for q, p in pairs]


class ExtractiveGenerator:
    """Answers with the context line that shares most words with the question, and cites it; of equal ones the first, or the last."""

    def __init__(self, last: bool = False) -> None:
        self.sign = 1 if last else -1

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            context, _, question = prompt.rpartition("Question: ")
            lines = [x for x in context.split("\n") if x.startswith("[")]
            asked = set(question.lower().split())
            best = max(range(len(lines)), key=lambda i: (len(asked & set(lines[i].lower().split())), self.sign * i), default=None)
            out.append("" if best is None else f"{lines[best].partition('] ')[2]} [อ้างอิง: {best + 1}]")
        return out


def embedded(text: Column, make: Callable[[], Embedder] = HashEmbedder) -> Column:
    @pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model.embed(texts.fillna("").tolist())))

    return embed(text)


def embedded_tokens(text: Column, make: Callable[[], MultiEmbedder] = HashMultiEmbedder) -> Column:
    @pandas_udf("array<array<float>>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([[list(v) for v in m] for m in model.embed_tokens(texts.fillna("").tolist())])

    return embed(text)


def segmented(make: Callable[[], Segmenter]) -> Callable[[Column], Column]:
    """A tokenizer over whole texts from a word segmenter, to stand in for ``words`` where a column of texts is cut."""

    @pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series([[w for w in ws if w.strip()] for ws in model.segment(texts.fillna("").str.lower().tolist())])

    return cut


def yes_no_prompt(instruction: str, question: Column, paragraph: Column) -> Column:
    """What a generative reranker is asked; the model answers yes or no."""
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), question, F.lit("\n<Document>: "), paragraph)


def yes_chance(yes: Column, no: Column) -> Column:
    """The softmax over two logits, at yes."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no - yes))


def yes_no_scored(prompt: Column, make: Callable[[], YesNoScorer]) -> Column:
    @pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for p in batches:
            yield pd.Series(np.asarray(model.logits(p.fillna("").tolist()), float).reshape(-1, 2).tolist())

    pair = logits(prompt)
    return F.get(F.transform(F.array(pair), lambda x: yes_chance(x[0], x[1])), F.lit(0))


def scored(question: Column, paragraph: Column, make: Callable[[], Scorer] = OverlapScorer) -> Column:
    @pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, p in batches:
            yield pd.Series(model.score(q.fillna("").tolist(), p.fillna("").tolist()), dtype="float64")

    return score(question, paragraph)


def with_scores(pairs: DataFrame, cached: DataFrame, keys: list[str], live: Column) -> DataFrame:
    """Cached scores, a live score where there is none, and the lowest score as a last resort."""
    return pairs.join(cached.withColumnRenamed("score", "_cached"), keys, "left").withColumn("score", F.coalesce("_cached", live, F.lit(-1e9))).drop("_cached")


def generated(prompts: DataFrame, make: Callable[[], Generator] = ExtractiveGenerator, group: str = "doc_id") -> DataFrame:
    """prompts with raw; rows of one document follow each other, so that a server can reuse their prefix."""
    schema = f"{', '.join(f'`{c}` {t}' for c, t in prompts.dtypes)}, raw string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(raw=model.generate(b["prompt"].tolist()))

    return prompts.repartition(group).sortWithinPartitions(group).mapInPandas(run, schema)


def parsed(outputs: DataFrame) -> DataFrame:
    """answer, refs (paragraph ids) and explicit from raw, para_ids, texts and query; empty answers fall back."""
    indices = citations.cited(F.col("raw"), F.size("para_ids"))
    refs = F.filter(F.transform(indices, lambda i: F.get("para_ids", i)), lambda x: x.isNotNull())
    answer = citations.answer_or_fallback(citations.without_tags(F.col("raw")), F.get("texts", F.lit(0)), F.col("query"))
    return outputs.withColumn("refs", refs).withColumn("answer", answer).withColumn("explicit", citations.has_citation(F.col("raw")))


def merged(answers: DataFrame, refs: DataFrame, key: str = "query_id") -> DataFrame:
    """The answer of one run with the evidence of another; a question that only one of them has fails the job."""
    one, two = answers.select(key, "answer", F.lit(True).alias("_a")), refs.select(key, "refs", F.lit(True).alias("_b"))
    both = one.join(two, key, "full")
    odd = F.raise_error(F.concat(F.lit("the two runs answer different questions: "), F.col(key).cast("string"))).cast("string")
    return both.select(key, F.when(F.col("_a") & F.col("_b"), F.col("answer")).otherwise(odd).alias("answer"), "refs")


def combinations(runs: DataFrame, key: str = "query_id") -> DataFrame:
    """All answer-by-evidence pairs of the runs of each question: combo ans<run>_ref<run>."""
    each = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("run", "answer", "refs"))).alias("r"))
    pairs = each.select(key, "r", F.explode("r").alias("a")).select(key, "a", F.explode("r").alias("b"))
    return pairs.select(key, F.concat(F.lit("ans"), "a.run", F.lit("_ref"), "b.run").alias("combo"), "a.answer", "b.refs")


def two_stage(prompts: DataFrame, mode: str, first: Callable[[], Generator] = ExtractiveGenerator, second: Callable[[], Generator] = ExtractiveGenerator) -> DataFrame:
    """Stage one over the full context, stage two as the mode says: filter, independent, or with a hint.

    The hint is the first stage's evidence (hint_fixed, hint_free), its answer (hint_answer) or both (hint_both).

    prompts: query_id, doc_id, query, para_ids, texts. Returns both stages' answers and refs (1 and 2).
    """
    from .prompts import context_first, hint, numbered

    one = parsed(generated(prompts.withColumn("prompt", context_first(numbered(F.col("texts")), F.col("query"))), first))
    one = one.select("query_id", "doc_id", "query", "para_ids", "texts", F.col("answer").alias("answer1"), F.col("refs").alias("refs1"))
    at = F.transform("refs1", lambda r: F.array_position("para_ids", r).cast("int") - 1)
    if mode == "filter":
        kept = F.filter(F.transform("para_ids", lambda p, i: F.when(F.array_contains("refs1", p), i)), lambda i: i.isNotNull())
        pick = lambda c: F.transform(kept, lambda i: F.get(c, i))
        two = one.withColumn("texts2", pick("texts")).withColumn("para_ids", pick("para_ids"))
        two = two.withColumn("prompt", context_first(numbered(F.col("texts2")), F.col("query")))
    elif mode in ("hint_fixed", "hint_free"):
        word = "Focus on: " if mode == "hint_fixed" else "Possibly relevant: "
        two = one.withColumn("prompt", context_first(numbered(F.col("texts")), F.col("query"), F.concat(F.lit(word), hint(at))))
    elif mode in ("hint_answer", "hint_both"):
        said = F.concat(F.lit("Preliminary answer: "), "answer1")
        both = F.concat(F.lit("Possibly relevant: "), hint(at), F.lit("\n"), said)
        two = one.withColumn("prompt", context_first(numbered(F.col("texts")), F.col("query"), said if mode == "hint_answer" else both))
    elif mode == "independent":
        two = one.withColumn("prompt", context_first(numbered(F.col("texts")), F.col("query")))
    else:
        raise ValueError(mode)
    return parsed(generated(two, second)).select("query_id", "answer1", "refs1", F.col("answer").alias("answer2"), F.col("refs").alias("refs2"))


def stage_combinations(stages: DataFrame, key: str = "query_id") -> DataFrame:
    """Each stage's answer with each stage's evidence: combo s1ans_s1ref, s1ans_s2ref, s2ans_s1ref, s2ans_s2ref."""
    each = F.array(*(F.struct(F.lit(f"s{a}ans_s{r}ref").alias("combo"), F.col(f"answer{a}").alias("answer"), F.col(f"refs{r}").alias("refs")) for a in (1, 2) for r in (1, 2)))
    return stages.select(key, F.inline(each))


def with_texts(refs: DataFrame, paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """refs with the text that each names; the empty text where a key names no paragraph."""
    named = paragraphs.select(*keys, F.col("text").alias("_text"))
    return refs.join(named, keys, "left").withColumn("text", F.coalesce("_text", F.lit(""))).drop("_text")


def folds(ids: Column, k: int, seed: str = "fold") -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), ids)), 1, 8), 16, 10).cast("long") % k


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by the order of a hash."""
    return df.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), key))).orderBy("_order", key).limit(n).drop("_order")

