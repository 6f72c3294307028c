"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed insult lexicon and of a learned one (words and word beginnings
that toxic training documents hold far more often than others), how often such words stand within NEAR words of
a second-person pronoun, shares of capitals, capitalised words, punctuation and exclamation marks, and rates of
obfuscated words (symbols or digits among letters; read back as letters they are looked up too) and of drawn
out letters.

Training rows are a sample, by hash of their id, of at most LABELLED labelled documents with crc32(doc_id as
text) mod 3 other than 1 (of rows with the same id one is used). One in CALIBRATE of them is kept from the learned
lexicon and the trees for the isotonic regression. Features are computed in Arrow batches; trees and calibration are Spark's own and score in the JVM. Labels, language,
source and doc_id enter no score.

Defined cases: null counts as empty; an empty text gets the score of a text without words; a document with
several labels counts as toxic if any says so; with labels of only one kind every score is that kind's share; a
null doc_id is not held out; repeated rows score alike; no rows give no rows; columns beside doc_id and text
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, one_each

LABELLED, CALIBRATE, NEAR, THRESHOLD = 20_000, 4, 5, 0.7
#: Learned lexicon: least number of toxic documents, least ratio of the shares, most entries, lengths of beginnings.
LEAST, RATIO, ENTRIES, BEGINNINGS = 8, 6.0, 400, (4, 5)
#: Insults in four languages, second-person pronouns, letters behind symbols.
INSULTS = """idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown disgusting dumb fool jerk
    ugly filth vermin imbecile cretin garbage retard bastard bitch shit fuck fucking asshole hate kill
    dumm idioten blöd arschloch scheisse scheiße abschaum widerlich wertlos trottel depp hure
    imbécile connard salaud pute merde crétin débile ordure abruti minable
    idiota estúpido estúpida imbécil basura asqueroso puta mierda cabrón inútil patético escoria""".split()
YOU = "you your yours yourself u ya du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su sus".split()
LEET = str.maketrans("013457@$!|", "oieastasil")
EDGE = "\"'.,;:!?()[]{}<>|*#%&$«»¿¡-_/\\"
NAMES = ["words", "insults", "learned", "learned_count", "learned_kinds", "near_you", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "obfuscated_insults", "drawn_out"]
CLASSES = np.zeros(256, np.int64)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1, 2, 3, 4
CLASSES[33] = 5
HEAD = min(BEGINNINGS)
_drawn = re.compile(r"([^\W\d_])\1\1")
_insults, _you = frozenset(INSULTS), frozenset(YOU)


def entries_of(word: str) -> list[str]:
    """What a word is looked up as: itself and its beginnings, which are marked."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def _marked(kinds: set[str], lexicon: frozenset[str], heads: frozenset[str]) -> set[str]:
    """Words with an entry in the lexicon; heads are the first signs of its beginnings."""
    found = kinds & lexicon
    if not heads.isdisjoint({w[:HEAD] for w in kinds}):
        found |= {w for w in kinds if w[:HEAD] in heads and not lexicon.isdisjoint(entries_of(w))}
    return found - {""}


def _drawn_out(kinds: set[str]) -> int:
    """How many words hold a letter three times running; words are only looked at if any sign stands so."""
    signs = np.frombuffer("\n".join(kinds).encode("utf-32-le"), np.uint32)
    same = signs[1:] == signs[:-1]
    return sum(1 for w in kinds if _drawn.search(w)) if (same[1:] & same[:-1]).any() else 0


def heads_of(lexicon: frozenset[str]) -> frozenset[str]:
    return frozenset(e[:HEAD] for e in lexicon if e.endswith("*"))


def features(text: str | None, lexicon: frozenset[str], heads: frozenset[str] | None = None) -> list[float]:
    """The features of a text; heads, if at hand, are heads_of(lexicon). Sets and maps keep most words out of the interpreter."""
    text = text or ""
    raw = text.split()
    lowered = list(map(str.strip, text.lower().split(), repeat(EDGE)))
    kinds = set(lowered)
    marked, insults = _marked(kinds, lexicon, heads_of(lexicon) if heads is None else heads), kinds & _insults
    hidden = [w for w in filterfalse(str.isalpha, kinds) if any(map(str.isalpha, w))]
    read_back = sum(w.translate(LEET) in _insults for w in hidden)
    any_hit, hits, near, fixed_hits = marked | insults, 0, 0, 0
    if any_hit:
        at = [i for i, w in enumerate(lowered) if w in any_hit]
        hits, fixed_hits = sum(lowered[i] in marked for i in at), sum(lowered[i] in insults for i in at)
        near = sum(not _you.isdisjoint(lowered[max(0, i - NEAR) : i + NEAR + 1]) for i in at) / len(at)
    n, per = max(len(raw), 1), np.bincount(CLASSES[np.frombuffer(text.encode(), np.uint8)], minlength=6)
    letters, size = max(int(per[1] + per[2]), 1), max(int(per.sum()), 1)
    return [
        float(np.log1p(len(raw))), fixed_hits / n, hits / n, float(np.log1p(hits)), float(len(marked)), near, per[1] / letters,
        sum(len(w) > 1 for w in filter(str.isupper, raw)) / n, per[4] / size, per[5] / size, len(hidden) / max(len(kinds), 1),
        float(read_back), _drawn_out(kinds) / max(len(kinds), 1),
    ]


def _entry_counts(docs: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """entry, n: in how many documents."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            counts: Counter[str] = Counter()
            for t in batch.column("text").to_pylist():
                own = {e for w in {w.strip(EDGE) for w in (t or "").lower().split()} for e in entries_of(w)}
                counts.update(own if wanted is None else own & wanted)
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])

    return docs.select("text").mapInArrow(work, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def learned_lexicon(known: DataFrame) -> frozenset[str]:
    """Entries that stand in RATIO times the share of toxic documents, those with the largest difference first."""
    toxic, other = known.where("toxic = 1"), known.where("toxic = 0")
    n_toxic, n_other = toxic.count(), other.count()
    if not n_toxic or not n_other:
        return frozenset()
    often = _entry_counts(toxic).where((F.col("n") >= max(LEAST, n_toxic // 200)) & (F.length("entry") > 2)).orderBy(F.desc("n"), "entry").limit(10 * ENTRIES)
    seen = {r["entry"]: r["n"] / n_toxic for r in often.collect()}
    others = {r["entry"]: r["n"] / n_other for r in _entry_counts(other, frozenset(seen)).collect()}
    good = [(p - others.get(e, 0.0), e) for e, p in seen.items() if p >= RATIO * (others.get(e, 0.0) + 1 / n_other)]
    return frozenset(e for _, e in sorted(good, reverse=True)[:ENTRIES])


def featured(docs: DataFrame, lexicon: frozenset[str], more: list[str] = ()) -> DataFrame:
    """doc_id, the further columns and features."""
    heads = heads_of(lexicon)

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            rows = [features(t.as_py(), lexicon, heads) for t in batch.column("text")]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", *more)), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", *more, "features"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *more)) + ", features array<double>"
    return docs.select("doc_id", *more, "text").mapInArrow(work, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~fold).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(LABELLED)
    known = one_each(docs.join(F.broadcast(sample), "doc_id"), ["toxic"])
    known = durable(known.withColumn("apart", F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), F.col("doc_id").cast("string"))), 1, 6), 16, 10).cast("long") % CALIBRATE == 0))
    lexicon = learned_lexicon(known.where("NOT apart"))
    train = durable(featured(known, lexicon, ["toxic", "apart"]))
    held = docs.select("doc_id", "text")
    shares = {(r["apart"], r["toxic"]) for r in train.select("apart", "toxic").distinct().collect()}
    if len({t for _, t in shares}) < 2 or len({t for apart, t in shares if not apart}) < 2:
        share = float(train.agg(F.avg("toxic")).first()[0] or 0.0)
        score = F.lit(share)
        return held.select("doc_id", fold.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
    vectors = lambda df: df.withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(labelCol="toxic", maxIter=15, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=1).fit(vectors(train.where("NOT apart")))
    chance = lambda df: trees.transform(vectors(df)).withColumn("chance", vector_to_array("probability")[1])
    fresh = train.where("apart") if len({t for apart, t in shares if apart}) == 2 else train
    steps = IsotonicRegression(labelCol="toxic", featuresCol="chance", predictionCol="score").fit(chance(fresh).select("chance", "toxic"))
    out = steps.transform(chance(featured(held, lexicon)).select("doc_id", "chance"))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", fold.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
