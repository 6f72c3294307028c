import json
import random

import pytest

from ranksheaf.sources import corpus, split_json


def made(seed, docs=60):
    rng = random.Random(seed)
    nasty = ["}", "{", '"', "\\", "]", "[", "é", "ที่", "\n", " ", '\\"', "}}]", ",", ":", "a"]
    text = lambda: "".join(rng.choice(nasty) for _ in range(rng.randrange(60)))
    ds = [{"doc_id": f"d{i}", "paragraphs": [{"para_id": f"P{k}", "text": text()} for k in range(rng.randrange(5))]} for i in range(docs)]
    refs = [None, "P1", ["P1", "P}2"], []]
    qs = [{"ID": f"Q{i}", "doc_id": f"d{i % docs}", "query": text(), "abstractive": text(), "refs": rng.choice(refs)} for i in range(2 * docs)]
    return {"note": {"docs": [{"not": "an element"}], "x": 1}, "docs": ds, "none": [], "queries": qs, "tail": "}]"}


@pytest.mark.parametrize("block", ["200", "977", "1m"])
@pytest.mark.parametrize("how", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_a_file_read_by_several_tasks(spark, tmp_path, block, how):
    want = made(f"{block}{sorted(how)}", 12 if block == "200" else 60)
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(want, **how) + "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = split_json.read_elements(spark, str(path))
        got = {(r.array, r.ord): json.loads(r.json) for r in rows.collect()}
        parts = split_json.pieces(spark, str(path)).rdd.getNumPartitions()
        ps, qs = corpus.split_corpus(spark, str(path))
        ps, qs = sorted(map(repr, ps.collect())), sorted(map(repr, qs.collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {(a, i): x for a in ("docs", "queries") for i, x in enumerate(want[a])}
    assert (parts > 8) == (block != "1m")
    plain = corpus.read_corpus(spark, str(path))
    assert ps == sorted(map(repr, corpus.paragraphs(plain).collect())) and qs == sorted(map(repr, corpus.questions(plain).collect()))


def test_files_without_elements(spark, tmp_path):
    for i, text in enumerate(["", "{}", '{"docs": []}', "[1, 2]", '{"docs": [1, "x}"]}\n\n']):
        (tmp_path / f"{i}.json").write_text(text)
    assert split_json.read_elements(spark, str(tmp_path)).count() == 0
