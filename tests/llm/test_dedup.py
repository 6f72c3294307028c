import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from helpers import BASE, SMALLER, near_components, no_documents, odd_documents
from oracle import assert_same
from ranksheaf.llm import exact_dedup, near_dedup, registry


def plain(rows):
    return sorted(rows, key=repr)


def test_exact_agrees_with_sql(spark):
    assert_same(registry.op7_exact_dedup(spark, SMALL), registry.ORACLE_SQL["op7_exact_dedup"], SMALL)


@pytest.mark.parametrize("parts,fan_in", [(1, 2), (7, 2), (9, 3)])
def test_exact_odd_cases(spark, parts, fan_in):
    docs = odd_documents(spark)
    got = exact_dedup.exact_dedup(docs.repartition(parts), fan_in).collect()
    rows = [(r.doc_id, (r.text or "").translate(SMALLER)) for r in docs.collect()]
    size = Counter(t for _, t in rows)
    best = {t: max((i for i, x in rows if x == t and i is not None), default=None) for t in size}
    assert plain((r.doc_id, r.keep_id, r.group_size) for r in got) == plain((i, best[t], size[t]) for i, t in rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256: 1 for r in got})
    assert exact_dedup.exact_dedup(no_documents(spark)).count() == 0


def test_exact_keeps_rows_whole(spark):
    docs = odd_documents(spark)
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(r.text or "").translate(SMALLER) for r in docs.collect()})
    assert exact_dedup.keep_first_copies(no_documents(spark)).count() == 0


def test_near_agrees_with_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op1_near_dedup(spark, SMALL).collect()
    assert plain((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(near_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_odd_cases(spark):
    docs = odd_documents(spark)
    got = near_dedup.near_dedup(docs).collect()
    want = near_components([(r.doc_id, r.text) for r in docs.collect()])
    # texts without words are linked with nothing
    assert plain((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(want)
    assert near_dedup.near_dedup(no_documents(spark)).count() == 0


def test_near_family_of_growing_distance(spark):
    """Each text is a little further from the first: only exact sets tell which are linked."""
    words = BASE.split()
    texts = [" ".join(f"v{i}" if 7 * j % 120 < i else w for j, w in enumerate(words)) for i in range(24) for _ in range(1)]
    chain = [" ".join(words[:i] + ["new"] * 0 + words[i:] + [f"t{i}"] * (i // 4)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts + chain + texts[:5])]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert plain((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(near_components(rows))


def test_near_shared_passage_links_nothing(spark):
    passage = " ".join(f"license{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(30))) for i in range(300)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 300


def test_near_large_group_costs_few_links(spark):
    words = BASE.split() * 2
    rows = [(i, " ".join(words[: i % 200] + [f"n{i}"] + words[i % 200 :])) for i in range(400)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.select("component_id").distinct().count() == 1


def test_components_follow_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("order", ["descending", "random", "zigzag"])
def test_components_take_few_rounds_on_long_paths(spark, monkeypatch, order):
    n = 1600
    path = {"descending": [0, *range(n - 1, 0, -1)], "random": random.Random(5).sample(range(n), n), "zigzag": [x for i in range(n // 2) for x in (i, n - 1 - i)]}[order]
    rounds = []
    plainly = near_dedup.durable_table
    monkeypatch.setattr(near_dedup, "durable_table", lambda df, *more: rounds.append(1) or plainly(df, *more))
    rows = [*zip(path, path[1:], strict=False), (n + 1, n + 2), (n + 2, n + 3), (n + 3, n + 1)]
    roots = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert roots == {**dict.fromkeys(range(n), 0), n + 1: n + 1, n + 2: n + 1, n + 3: n + 1}
    assert len(rounds) < 60


def test_components_of_no_links(spark):
    assert near_dedup.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_near_keeps_rows_whole(spark):
    docs = odd_documents(spark)
    kept = near_dedup.keep_representatives(docs.where("doc_id IS NOT NULL"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 9, 13, 14, 15, 16}


def test_signatures_agree_as_sets_do(spark):
    docs = spark.createDataFrame([(0, BASE), (1, BASE + " tail end")], "doc_id long, text string")
    a, b = (r.signature for r in near_dedup.signatures(docs).orderBy("doc_id").collect())
    assert sum(x == y for x, y in zip(a, b, strict=True)) >= near_dedup.T
    assert near_dedup.signatures(docs.select("doc_id", F.lit("").alias("text"))).first().signature is None
