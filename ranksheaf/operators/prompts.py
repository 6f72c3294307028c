"""Prompt contexts, hints, chat messages and a registry of prompt variants, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE = "array<struct<role:string,content:string>>"


def numbered(texts: Column, label: str = "[{}] ") -> Column:
    """'[1] text' lines in order."""
    before, after = label.split("{}")
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), t)), "\n")


def hint(indices: Column) -> Column:
    """1-based places joined by commas; a dash if there are none."""
    return F.when(F.size(indices) == 0, F.lit("—")).otherwise(F.array_join(F.transform(indices, lambda i: (i + 1).cast("string")), ", "))


def context_first(context: Column, question: Column, more: Column | None = None) -> Column:
    """The long, shared part comes first, so that a serving engine can reuse its prefix."""
    parts = [F.lit("Context:\n"), context, F.lit("\n\n"), *([more, F.lit("\n\n")] if more is not None else []), F.lit("Question: "), question]
    return F.concat(*parts)


def question_first(context: Column, question: Column, more: Column | None = None) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nContext:\n"), context, *([F.lit("\n\n"), more] if more is not None else []))


#: What is asked when one of several candidate paragraphs is to be picked, and how much of each is shown.
PICK = ("คำถาม: ", "ย่อหน้าผู้สมัคร {} ตัว:\n", "คำสั่ง: เลือกย่อหน้าที่ตอบคำถามได้ดีที่สุดเพียงหมายเลขเดียว ตอบเป็นหมายเลขในวงเล็บ เช่น [3] เท่านั้น ห้ามอธิบายเพิ่ม\nคำตอบ: [")
SHOWN = 400


def pick_prompt(question: Column, candidates: Column, shown: int = SHOWN) -> Column:
    """Asks for the number of the best of some candidate texts, each cut to ``shown`` characters."""
    before, after = PICK[1].split("{}")
    many = F.concat(F.lit(before), F.size(candidates).cast("string"), F.lit(after))
    cut = F.transform(candidates, lambda t: F.substring(t, 1, shown))
    return F.concat(F.lit(PICK[0]), question, F.lit("\n\n"), many, numbered(cut), F.lit("\n\n" + PICK[2]))


#: What a prompt variant is put together from.
INSTRUCTIONS = {
    "plain": "Answer from the context.",
    "cite": "Answer from the context and cite paragraphs as [อ้างอิง: numbers].",
    "short": "Answer in one short sentence and cite paragraphs as [อ้างอิง: numbers].",
    "quote": "Answer with words of the context and cite paragraphs as [อ้างอิง: numbers].",
    "two_lines": "Write คำตอบ: and the answer, then ย่อหน้าที่ใช้: and the paragraph numbers.",
}
ORDERS: dict[str, Callable[..., Column]] = {"context_first": context_first, "question_first": question_first}
LABELS = {"bracket": "[{}] ", "paragraph": "ย่อหน้า {}: "}
HINTS = ("none", "places", "answer", "both")


class Variant(NamedTuple):
    """A way to put a prompt together: system text, order of the parts, how paragraphs are numbered, what is hinted."""

    system: str
    order: str
    label: str
    hints: str

    def prompt(self, texts: Column, question: Column, places: Column | None = None, answer: Column | None = None) -> Column:
        more = []
        if self.hints in ("places", "both") and places is not None:
            more += [F.lit("Possibly relevant: "), hint(places)]
        if self.hints in ("answer", "both") and answer is not None:
            more += [F.lit("\n" if more else ""), F.lit("Preliminary answer: "), answer]
        return ORDERS[self.order](numbered(texts, LABELS[self.label]), question, F.concat(*more) if more else None)


#: All variants by name: instruction.order.label.hints.
VARIANTS = {
    ".".join(parts): Variant(INSTRUCTIONS[parts[0]], *parts[1:]) for parts in product(INSTRUCTIONS, ORDERS, LABELS, HINTS)
}


def chosen(names: list[str] | None = None) -> dict[str, Variant]:
    """All variants, or those whose name starts with one of the given."""
    return {n: v for n, v in VARIANTS.items() if names is None or any(n == x or n.startswith(f"{x}.") for x in names)}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: str, prompt: Column, shots: Column | None = None) -> Column:
    """System turn, the turns of worked examples, the user's turn."""
    head, tail = F.array(message("system", F.lit(system))).cast(MESSAGE), F.array(message("user", prompt)).cast(MESSAGE)
    return F.concat(head, shots.cast(MESSAGE), tail) if shots is not None else F.concat(head, tail)


def laid_out(messages: Column, answer_next: bool = True) -> Column:
    """Messages as one text by the common chat template, with the opening of the answer to come."""
    each = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(each, ""), F.lit("<|im_start|>assistant\n" if answer_next else ""))


def shot_turns(shots: Column) -> Column:
    """An array of (question, answer) as user and assistant turns."""
    return F.flatten(F.transform(shots, lambda s: F.array(message("user", s["question"]), message("assistant", s["answer"]))))


def contexts(paragraphs: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Per key: texts and ids of the paragraphs in order, and the numbered context."""
    rows = paragraphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "para_id", "text"))).alias("p"))
    rows = rows.select(*keys, F.transform("p", lambda x: x["para_id"]).alias("para_ids"), F.transform("p", lambda x: x["text"]).alias("texts"))
    return rows.withColumn("context", numbered(F.col("texts")))


def kept_by_citation(paragraphs: DataFrame, cited: DataFrame, keys: list[str], fallback: int = 5) -> DataFrame:
    """Only cited paragraphs in document order; where none is, the first few."""
    marked = paragraphs.join(cited.select(*keys, "para_id").distinct().withColumn("_cited", F.lit(1)), [*keys, "para_id"], "left")
    any_cited = F.max("_cited").over(Window.partitionBy(*keys))
    marked = marked.withColumn("_any", any_cited)
    return marked.where(F.when(F.col("_any").isNotNull(), F.col("_cited").isNotNull()).otherwise(F.col("pos") <= fallback)).drop("_cited", "_any")
