"""Secret scans with a trigram inverted index.

From each rule's regular expression the trigrams that any match must hold are derived, as alternatives (OR) of
sets (AND). The index posts every document under those of its trigrams that some rule asks for; postings are
intersected per alternative by one aggregation, and only documents that pass are verified with the rule's
expression. A rule without mandatory trigrams (hex runs) scans every document. The index is over lower-cased
text, so it finds at least what any mix of cases matches.

Positions come from built-ins alone: between k matches of an expression a split leaves k + 1 pieces, and the
prefix sums of piece and match lengths are the spans.

Postings are narrow rows (trigram number, doc_id) combined before they are shuffled; a common trigram is no hot
key, since they are grouped by document. The candidates are broadcast behind a check of their number and
joined by a shuffle beyond it.

Defined cases: null text counts as empty and has no spans; matches whose value is too short are dropped after
matching and are not searched again; kinds may overlap; of equal starts the kind listed first comes first;
repeated rows give a row each; a null doc_id is searched like any other; no rows give no rows; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import re
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, durable


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which they are listed.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: What the scan adds.
MORE = [
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
]
RULES = BASE + MORE
#: At most so many strings or alternatives are followed at a time.
WIDEST = 16


def _strings(parsed) -> list[list[set[str]]]:
    """A parsed expression as a sequence of runs; a run is a list of string sets that follow each other directly."""
    runs: list[list[set[str]]] = [[]]
    for op, arg in parsed:
        name, exact = str(op), None
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            exact = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            inner = _strings(arg[-1])
            runs[-1] += inner[0]
            runs += inner[1:]
            continue
        elif name == "BRANCH":
            inner = [_strings(branch) for branch in arg[1]]
            if all(len(i) == 1 for i in inner):
                exact = set().union(*(_joined(i[0]) for i in inner))
        elif name == "MAX_REPEAT":
            low, high, what = arg
            inner = _strings(what)
            if (low, high) == (0, 1) and len(inner) == 1:
                exact = _joined(inner[0]) | {""}
            elif low:
                runs[-1] += inner[0]
                runs += [*inner[1:], []]
                continue
        if exact is None or len(exact) > WIDEST:
            runs.append([])
        else:
            runs[-1].append(exact)
    return runs


def _joined(run: list[set[str]]) -> set[str]:
    return {"".join(p) for p in product(*run)}


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams one of which every match holds in full; [] if there are no mandatory ones."""
    needed = []
    for run in _strings(re._parser.parse(pattern)):
        # longest stretches whose strings are few
        stretch: list[set[str]] = []
        for exact in [*run, set()]:
            if exact and len(_joined([*stretch, exact])) <= WIDEST:
                stretch.append(exact)
                continue
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in _joined(stretch)}
            if sets and all(sets):
                needed.append(sets)
            stretch = [exact] if exact else []
    out = {frozenset()}
    for sets in needed:
        if len(out) * len(sets) <= WIDEST:
            out = {a | b for a in out for b in sets}
    return sorted(out - {frozenset()}, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """doc_id, trigram (its number): the inverted index for these trigrams."""
    lowered = docs.select("doc_id", F.lower("text").alias("_low"))
    here = F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)))
    return lowered.select("doc_id", F.explode(F.array_compact(here)).alias("trigram"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, kinds: for which rules a document must be verified; rules that scan fully are left out."""
    alternatives = [(r.kind, sorted(a)) for r in rules for a in trigram_query(r.pattern)]
    trigrams = sorted({t for _, a in alternatives for t in a})
    # rows (trigram, alternative, its bit, all bits): a table of constants
    wanted = [(trigrams.index(t), n, 1 << i, (1 << len(a)) - 1, kind) for n, (kind, a) in enumerate(alternatives) for i, t in enumerate(a)]
    wanted = docs.sparkSession.createDataFrame(wanted, "trigram int, alternative int, bit long, full long, kind string")
    met = postings(docs, trigrams).join(F.broadcast(wanted), "trigram").groupBy("doc_id", "alternative", "kind", "full").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = full").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _verified(rule: Rule, text: Column, due: Column) -> Column:
    """Lengths of the pieces between matches, of the matches and of their values."""
    expression = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, F.length)
    matches = F.when(due, F.regexp_extract_all(text, expression, F.lit(0)))
    values = lengths(F.regexp_extract_all(text, expression, F.lit(rule.group))) if rule.group else lengths(matches)
    return F.when(F.size(matches) > 0, F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("piece"), lengths(matches).alias("match"), values.alias("value")))


def found_spans(docs: DataFrame, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _row per input row; _row, kind, order, start, end per span in code points)."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    due = durable(candidates(docs, rules)).withColumnRenamed("doc_id", "_id")
    rows = docs.join(checked_broadcast(due, due.count()), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text = F.col("text")
    checked = rows.select(
        "doc_id",
        F.monotonically_increasing_id().alias("_row"),
        *(_verified(r, text, F.array_contains("kinds", r.kind) if trigram_query(r.pattern) else F.lit(True)).alias(f"_{i}") for i, r in enumerate(rules)),
    )
    checked = durable(checked)
    each = F.array_compact(F.array(*(F.when(F.col(f"_{i}").isNotNull(), F.struct(F.lit(i).alias("order"), F.col(f"_{i}").alias("parts"))) for i in range(len(rules)))))
    parts = checked.select("_row", F.inline(each)).select("_row", "order", F.posexplode("parts").alias("at", "p")).select("_row", "order", "at", "p.*")
    so_far = F.sum(F.col("piece") + F.coalesce("match", F.lit(0))).over(Window.partitionBy("_row", "order").orderBy("at"))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("order") + 1)
    kinds = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("order") + 1)
    spans = parts.withColumn("end", so_far).where((F.col("match") > 0) & (F.col("value") >= least))
    return checked.select("doc_id", "_row"), spans.select("_row", kinds.alias("kind"), "order", (F.col("end") - F.col("match")).alias("start"), "end")


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows, spans = found_spans(docs, rules)
    base = len(BASE)
    listed = F.sort_array(F.collect_list(F.struct("start", "order", F.concat_ws(":", "kind", "start", "end").alias("span"))))
    per_row = spans.groupBy("_row").agg(listed.alias("all"), *(F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda s: s["span"]), ",")
    none = F.array().cast("array<struct<start:bigint,order:int,span:string>>")
    out = rows.join(per_row, "_row", "left").withColumn("all", F.coalesce("all", none))
    return out.select(
        "doc_id",
        *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(joined(F.filter("all", lambda s: s["order"] < base)), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
    )
