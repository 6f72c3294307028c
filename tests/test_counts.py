from collections import Counter
from hashlib import md5

import pytest

from conftest import SMALL
from ranksheaf.operators import counts
from ranksheaf.plans import additions, extras, mechanisms, registry, studies  # noqa: F401

KIND = "doc_id long, ts array<array<string>>, q array<string>"
ROWS = [
    (0, [["a", "b", "a"], [], ["b", "c", "ก"]], ["a", "c", "a"]),
    (1, [["x"]], ["x"]),
    (2, [[], ["a", "d", "e", "f", "a", "a"], ["a"]], ["a", "zz"]),
    (3, [], []),
]


def bucket(word, at):
    return int(md5(word.encode()).hexdigest()[at : at + 4], 16) % 64


def by_hand(ts, q):
    where = [Counter(bucket(w, 0) for w in p) for p in ts]
    df = Counter(w for p in ts for w in set(p))
    share = lambda a, b: ((bucket(a, 0) == bucket(b, 0)) + (bucket(a, 4) == bucket(b, 4))) / 2
    return (
        [[p.count(w) for w in q] for p in ts], [sum(c[bucket(w, 0)] for w in q) for c in where], [sum(x * x for x in c.values()) for c in where],
        sum(x * x for x in Counter(bucket(w, 0) for w in q).values()), [sum(x == i + 1 for x in df.values()) for i in range(len(ts))], [sum(max((share(a, b) for b in p), default=0) for a in q) for p in ts],
    )


@pytest.mark.parametrize("block", [1, 6, 1 << 19])
def test_counts_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(counts, "BLOCK", block)
    df = spark.createDataFrame(ROWS, KIND).coalesce(1)
    got = {r.doc_id: r.c for r in df.select("doc_id", counts.counted(late=True)("ts", "q").alias("c")).collect()}
    for doc_id, ts, q in ROWS:
        c = got[doc_id]
        assert (c.tf, c.dot, c.norm, c.asked_norm, c.standing, c.late) == by_hand(ts, q)


def test_each_word_is_hashed_once_a_block(monkeypatch):
    import pyarrow as pa

    seen, real = [], counts.buckets
    monkeypatch.setattr(counts, "buckets", lambda words: seen.extend(words) or real(words))
    counts.block_counts(pa.array([[["a", "b"] * 50, ["a"] * 40]] * 7), pa.array([["a", "c"]] * 7), True)
    assert sorted(seen) == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["cap_sweep", "candidate_hard_constraints", "stage_filter_context", "rerank_fallback_join", "column_merge"])
def test_evidence_is_computed_once(spark, name, monkeypatch):
    from ranksheaf.operators import evidence

    made, real = [], evidence.scored
    monkeypatch.setattr(evidence, "scored", lambda *a, **k: made.append(1) or real(*a, **k))
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(made) == 1 and plan.count("ArrowEvalPython") <= 1 and plan.count("documents.parquet") <= 1


@pytest.mark.parametrize("name, exchanges", [("flagship_retrieval_eval", 1), ("rank_metrics_hit_mrr_iou", 0), ("gold_reachability", 1), ("logreg_policies", 1), ("full_document_reranked", 0), ("score_shape", 0)])
def test_paragraphs_are_not_shuffled(spark, name, exchanges, monkeypatch):
    from ranksheaf.operators import evidence

    monkeypatch.setattr(evidence, "SPREAD_BYTES", -1)
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == exchanges and "Join" not in plan and "Window" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("block", [1, 90, 1 << 22])
def test_products_are_those_of_the_counts(spark, monkeypatch, block):
    monkeypatch.setattr(counts, "TEXTS", block)
    rows = [(doc_id, [" ".join(p) for p in ts], q) for doc_id, ts, q in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, texts array<string>, q array<string>").coalesce(1)
    got = {r.doc_id: r.c for r in df.select("doc_id", counts.products()("texts", "q").alias("c")).collect()}
    for doc_id, ts, q in ROWS:
        assert (got[doc_id].dot, got[doc_id].norm, got[doc_id].asked_norm) == by_hand(ts, q)[1:4]


def test_score_shape_makes_only_dense_scores(spark):
    plan = registry.QUERIES["score_shape"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "multiply(" in plan and all(f"AS {name}" not in plan for name in ("bm25", "is_gold", "phrase", "rd", "rb"))


def test_dense_scores_are_those_of_the_evidence(spark):
    from ranksheaf.operators import evidence

    odd = [None, "", "\n\n", "---\n===", "one", "***\nÄß ΑΣ İx ภาษาไทย\n« »\nx", "a  b\tc,d;e\n  lead trail  \nA_b 1²", "!!\n??\n!word!\n   z y", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11\nw2 w4"]
    docs = spark.createDataFrame([(i, t) for k in range(3) for i, t in enumerate(odd, k * len(odd))], "doc_id long, text string").unionByName(
        spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    )
    want = {r.doc_id: r.d for r in evidence.scored(docs).selectExpr("doc_id", "s.dense AS d").collect()}
    got = {r.doc_id: r.dense for r in evidence.dense_scores(docs).collect()}
    assert len(want) > 200 and got == want
