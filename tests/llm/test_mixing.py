import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from helpers import WORD, no_documents, odd_documents
from oracle import assert_same
from ranksheaf.llm import mixing, registry


def filled(sizes, cap=3):
    """Water-filling step by step: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] / w > cap * sizes[s] + 1e-9}
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else rest * weight[s] / w for s in names}
        capped |= over


def test_agrees_with_sql(spark):
    assert_same(registry.op10_mix_sources(spark, SMALL), registry.ORACLE_SQL["op10_mix_sources"], SMALL)


def test_odd_cases(spark):
    docs = odd_documents(spark)
    sizes, n = defaultdict(int), 0
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = filled(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert {(round(r.target, 6), r.source_size) for r in got} == {(round(want[s], 6), sizes[s]) for s in sizes}
    for r in got:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.taken == r.size * r.copies <= 3 * r.size
        n += r.taken
    assert sorted(mixing.mix(docs.repartition(5)).collect(), key=repr) == sorted(got, key=repr)
    assert mixing.mix(no_documents(spark)).count() == 0


@settings(max_examples=12, deadline=None)
@given(sizes=st.lists(st.integers(0, 400), min_size=1, max_size=9))
def test_targets_are_filled(spark, sizes):
    rows = [(False, f"s{i}", n, 1) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "_null boolean, source string, source_size long, n long")).collect()}
    assert got == pytest.approx(filled({f"s{i}": n for i, n in enumerate(sizes)}))
    assert sum(got.values()) == pytest.approx(sum(sizes))


def test_taken_comes_near_the_target(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 7 if i % 3 else 0}") for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.02 for r in per)


def test_draws_that_are_not_tied(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for r in mixing.mix(docs, tied=False).collect():
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:12], 16) / (1 << 48)
        rate = r.target / r.source_size
        assert r.copies == int(rate) + (u < rate - int(rate))


@pytest.mark.parametrize("block", [7, 50])
def test_small_blocks_and_shuffled_joins_draw_alike(spark, monkeypatch, block):
    """Many strata; and with a limit of 1 on broadcasts every join of sources, classes and strata is shuffled."""
    docs = odd_documents(spark)
    monkeypatch.setattr(mixing, "BLOCK", block)
    want = sorted(mixing.mix(docs).collect(), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(mixing.mix(docs).collect(), key=repr) == want


def test_documents_repeat_as_taken(spark):
    docs = odd_documents(spark)
    want = sum(r.copies for r in mixing.mix(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == want
    assert mixing.mixed_documents(no_documents(spark)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_mixed_rows_are_the_same_in_every_run(spark, broadcast_rows):
    """Rows of one id, or of none, with different texts: each is taken as often as its own draw says, whatever the order."""
    rows = [(i // 3 if i % 4 else None, f"text {i} " + "word " * (i % 17), f"s{i % 5}" if i % 7 else None) for i in range(300)]
    rows += [(1, "alike in all", "s1")] * 5 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [Counter(map(tuple, mixing.mixed_documents(d, broadcast_rows=broadcast_rows).collect())) for d in (df.repartition(3), df.orderBy(F.rand(1)), df.repartition(11, "text"))]
    assert runs[0] == runs[1] == runs[2]
    taken = Counter()
    for r in mixing._mixed(df, mixing.CAP, mixing.SEED).collect():
        taken[r.doc_id, r._t] += r.copies
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    got = Counter()
    for (d, t, _), n in runs[0].items():
        got[d, hashes[d, t]] += n
    assert +got == +taken
