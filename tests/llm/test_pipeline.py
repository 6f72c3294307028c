import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from helpers import SMALLER, labels, near_components, no_documents, odd_documents


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over the smallest tables."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SMALL).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs.collect(), result.collect(), result.columns))
        docs = result
    return out


def test_columns_stay(spark, stages):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert [s[0] for s in stages] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing", "packing"]
    assert all(s[3] == columns for s in stages[:-1])


def test_exact_stage_is_brute_force(stages):
    _, before, after, _ = stages[1]
    best = {}
    for r in before:
        key = r.text.translate(SMALLER)
        best[key] = max(best.get(key, -1), r.doc_id)
    assert {r.doc_id for r in after} == set(best.values()) and len(after) == len(best)


def test_near_stage_is_brute_force(stages):
    _, before, after, _ = stages[2]
    want = {i for i, _, c in near_components([(r.doc_id, r.text) for r in before]) if i == c}
    assert {r.doc_id for r in after} == want


def test_mixing_stage_takes_whole_documents(stages):
    _, before, after, _ = stages[3]
    assert set(after) <= set(before) and max(after.count(r) for r in set(after)) <= 3


def test_packing_stage_holds_every_document(stages):
    _, before, after, _ = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    copies = {r.doc_id: 0 for r in before}
    for r in before:
        copies[r.doc_id] += 1
    for i, n in copies.items():
        pieces = [r for r in after if r.doc_id == i]
        assert sum(r.length for r in pieces) == n * pieces[0].doc_tokens


def test_run_is_its_stages(spark, stages):
    ran = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, ran.collect())) == sorted(map(str, stages[-1][2]))


@pytest.mark.parametrize("at", range(5))
def test_stages_take_odd_rows(spark, at, tmp_path):
    marks = labels(spark)
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd_documents(spark)
    for d in (docs, no_documents(spark)):
        out = corpus_pipeline.STAGES[at][1](spark, d, str(tmp_path))
        if at == 4:
            assert out.agg(F.count_if(F.col("start") == 0)).first()[0] == d.count()
        else:
            assert out.columns == docs.columns and out.count() <= 3 * d.count()
