import json
import math
import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ranksheaf.functions import text
from ranksheaf.operators import analysis, evidence, inference, pools, prompts, vectors
from ranksheaf.sources import corpus, sinks
from ranksheaf.streaming import scoring

TEXT = "red fox runs far away from home\nblue bird sings a loud song today\nred fox sleeps\nsea wind is cold\nblue sky over the sea"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_hand(texts, q):
    """Okapi BM25 with the average-idf floor, as the definition says."""
    n, avg = len(texts), sum(map(len, texts)) / len(texts)
    df = {t: sum(t in d for d in texts) for d in texts for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in q) for d in texts]


def test_bm25_by_hand(spark):
    e = evidence.evidence(docs(spark, [(0, TEXT)])).orderBy("pos").collect()
    texts = [x.split() for x in TEXT.split("\n")]
    q = texts[0][1:9][::2]
    assert [r.bm25 for r in e] == pytest.approx([round(x, 9) for x in by_hand(texts, q)], abs=1e-8)
    assert [r.is_gold for r in e] == [1, 0, 0, 0, 0]


def test_frequent_words_take_the_floor(spark):
    text = "\n".join(f"x common common word{i} here there" for i in range(5)) + "\nlast one"
    e = evidence.evidence(docs(spark, [(0, text)])).orderBy("pos").collect()
    texts = [x.split() for x in text.split("\n")]
    assert [r.bm25 for r in e] == pytest.approx(by_hand(texts, texts[0][1:9][::2]), abs=1e-8)


def test_short_and_empty_documents_ask_nothing(spark):
    assert evidence.evidence(docs(spark, [(2, ""), (3, None), (4, "___\n...")])).count() == 0
    assert evidence.evidence(docs(spark, [])).count() == 0


def test_fusion_of_one_list_keeps_it(spark):
    e = evidence.evidence(docs(spark, [(0, TEXT)])).withColumn("s", evidence.rrf_score("rb")).withColumn("r", evidence.by_score("s"))
    assert e.where("r <> rb").count() == 0


def test_weights_at_the_ends_are_the_parts(spark):
    e = evidence.evidence(docs(spark, [(0, TEXT)]))
    for alpha, rank in ((0.0, "rd"), (1.0, "rb")):
        assert e.withColumn("s", evidence.rounded(evidence.weighted_score("dense", "bm25", alpha))).withColumn("r", evidence.by_score("s")).where(F.col("r") != F.col(rank)).count() == 0


def test_large_pool_is_everything(spark):
    e = evidence.evidence(docs(spark, [(0, TEXT)]))
    p = evidence.union_pool(e, 1000).orderBy("pool_pos").collect()
    assert [r.pool_pos for r in p] == [1, 2, 3, 4, 5] and [r.rd for r in p] == [1, 2, 3, 4, 5]


def test_constant_scores_scale_to_zero(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 2, 2.0)], "doc_id long, pos long, s double")
    assert [r.x for r in df.select(evidence.min_max("s").alias("x")).collect()] == [0.0, 0.0]


def test_adaptive_keeps_one_at_least(spark):
    e = spark.createDataFrame([(0, 1, 1, 1, 1, -1.0), (0, 2, 1, 0, 2, -2.0)], "doc_id long, pos long, n_gold long, is_gold long, rd long, dense double")
    for kind in ("gap", "threshold", "ratio"):
        assert pools.adaptive(e, kind, [0.5]).first().mean_k == 1.0


def test_correlation_and_auc_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1), (2.0, 5.0, 1)], "a double, b double, y int").withColumn("k", F.lit(0))
    assert analysis.correlation(df, "a", "b", ["k"]).first().r == 0.0
    assert analysis.rank_sum_auc(df, "a", "y", ["k"]).first().auc == 0.5


def test_leaderboard_cases(spark):
    computed = spark.createDataFrame([("detail", 0.7), ("same", 0.7), ("off", 0.7), ("fixed", 0.7)], "system string, composite double")
    stored = spark.createDataFrame([("json", 0.6, False), ("same", 0.7001, False), ("off", 0.71, False), ("fixed", 0.71, True)], "system string, stored double, has_fixed boolean")
    labels = spark.createDataFrame([("same", "m")], "system string, model string")
    r = {x.system: (x.source, x.composite, x.flag, x.model) for x in analysis.reconciled(computed, stored, labels).collect()}
    assert r == {"detail": ("detail", 0.7, "", "?"), "json": ("stored", 0.6, "", "?"), "same": ("detail", 0.7, "", "m"), "off": ("detail", 0.7, "disagrees", "?"), "fixed": ("fixed", 0.71, "disagrees", "?")}
    board = spark.createDataFrame([("a", 0.1, 0.2, 0.3, 0.2, 0.1)], "system string, rouge_l double, ss double, iou double, composite double, answer_sub double")
    assert "| a | 0.1000 |" in sinks.leaderboard_markdown(board, "kept")


def test_composite_is_linear(spark):
    d = spark.createDataFrame([("s", 0.1, 0.5, 0.2), ("s", 0.3, 0.7, 1.0)], "system string, rouge_l double, ss double, iou double")
    rows = d.select(F.avg(analysis.composite(F.col("rouge_l"), F.col("ss"), F.col("iou"))).alias("x")).first().x
    assert analysis.summary(d, ["system"]).first().composite == pytest.approx(rows, abs=1e-6)


def test_empty_bins_stay(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert [(r.bin, r.n) for r in analysis.binned(df, F.col("x"), [0.0, 2.0, 4.0], []).orderBy("bin").collect()] == [(0, 1), (1, 0)]


def test_corpus_files(spark, tmp_path):
    path = tmp_path / "test.json"
    path.write_text(json.dumps({"docs": [{"doc_id": "d", "paragraphs": [{"para_id": "P1", "text": "a"}, {"para_id": "P2", "text": "___"}]}], "queries": [{"ID": "q1", "doc_id": "d", "query": "?", "refs": "P1"}, {"ID": "q2", "doc_id": "d", "query": "?", "refs": ["P1", "P2"]}, {"ID": "q3", "doc_id": "d", "query": "?"}]}))
    c = corpus.read_corpus(spark, str(path))
    assert [(r.para_id, r.pos, r.is_valid) for r in corpus.paragraphs(c).orderBy("pos").collect()] == [("P1", 1, True), ("P2", 2, False)]
    assert [r.refs for r in corpus.questions(c).orderBy("query_ord").collect()] == [["P1"], ["P1", "P2"], []]


def test_pair_scores(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"q": [["P2", 0.1], ["P1", 0.9]]}))
    p = corpus.read_pair_scores(spark, str(tmp_path / "s.json"))
    assert [(r.para_id, r.pool_pos) for r in p.orderBy("pool_pos").collect()] == [("P2", 0), ("P1", 1)]
    assert corpus.sorted_pair_scores(p, 1).first().para_id == "P1"
    (tmp_path / "h.json").write_text(json.dumps({"q": "text"}))
    queries = spark.createDataFrame([("q", "a"), ("r", "b")], "query_id string, query string")
    h = corpus.read_hypotheses(spark, str(tmp_path / "h.json"))
    assert {r.query_id: r.to_embed for r in corpus.with_hypotheses(queries, h).collect()} == {"q": "text", "r": "b"}
    assert corpus.missing_hypotheses(queries, h).first().query_id == "r"


def test_details_know_their_experiment(spark, tmp_path):
    folder = tmp_path / "exp7" / "eval_result" / "ansB"
    folder.mkdir(parents=True)
    (folder / "detail.csv").write_text("ID,rougeL,SS-score,IoU\nq,0.1,0.2,0.3\n")
    r = corpus.read_score_files(spark, [str(folder / "detail.csv")]).first()
    assert (r.exp, r.combo, r.iou) == ("exp7", "ansB", 0.3)


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("q2", 1, 'a "b"\nc', ["P1", "P2"], "x"), ("q1", 0, "d", [], "y")], "query_id string, query_ord int, answer string, refs array<string>, combo string")
    sinks.write_submission(p, str(tmp_path / "s"))
    back = {r.query_id: (r.answer, r.refs) for r in corpus.read_submission(spark, str(tmp_path / "s")).collect()}
    assert back == {"q2": ('a "b"\nc', ["P1", "P2"]), "q1": ("d", [])}
    sinks.write_combinations(p, str(tmp_path / "c"))
    assert sorted(x.name for x in (tmp_path / "c").glob("combo=*")) == ["combo=x", "combo=y"]
    sinks.write_detail(spark.createDataFrame([("q", 0.1, 0.2, 0.3)], "query_id string, rouge_l double, ss double, iou double"), str(tmp_path / "d"))
    assert corpus.read_detail(spark, str(tmp_path / "d")).first().ss == 0.2


@pytest.mark.parametrize("mode", ["filter", "hint_fixed", "hint_free", "hint_answer", "hint_both", "independent"])
def test_two_stages(spark, mode):
    p = spark.createDataFrame([("q", "d", "red fox", ["P1", "P2"], ["sea wind", "a red fox"])], "query_id string, doc_id string, query string, para_ids array<string>, texts array<string>")
    r = inference.two_stage(p, mode).first()
    assert (r.answer1, r.refs1, r.answer2, r.refs2) == ("a red fox", ["P2"], "a red fox", ["P2"])


def test_merge_refuses_other_questions(spark):
    a = spark.createDataFrame([("q1", "x", ["P1"])], "query_id string, answer string, refs array<string>")
    b = spark.createDataFrame([("q2", "y", ["P2"])], "query_id string, answer string, refs array<string>")
    with pytest.raises(Exception, match="different questions"):
        inference.merged(a, b).collect()
    assert inference.merged(a, a).first().answer == "x"


def test_models_plug_in(spark):
    df = spark.createDataFrame([("red fox", "a red fox"), (None, "x")], "q string, p string")
    r = df.select(inference.scored(F.col("q"), F.col("p")).alias("s"), inference.embedded(F.col("p")).alias("v")).collect()
    assert [x.s for x in r] == [1.0, 0.0] and len(r[0].v) == 64


def test_prompts(spark):
    r = spark.range(1).select(prompts.numbered(F.array(F.lit("a"), F.lit("b"))).alias("c"), prompts.hint(F.array().cast("array<int>")).alias("h"), prompts.hint(F.array(F.lit(0), F.lit(2))).alias("i"), prompts.chat("s", F.lit("u")).alias("m"), prompts.question_first(F.lit("c"), F.lit("q")).alias("q")).first()
    assert (r.c, r.h, r.i, [x.role for x in r.m]) == ("[1] a\n[2] b", "—", "1, 3", ["system", "user"]) and r.q.startswith("Question: q")
    assert len(prompts.chosen(["cite"])) == 16 and len(prompts.chosen()) == 80
    v = prompts.VARIANTS["cite.context_first.paragraph.both"]
    r = spark.range(1).select(v.prompt(F.array(F.lit("a")), F.lit("q"), F.array(F.lit(0)), F.lit("x")).alias("p")).first()
    assert r.p == "Context:\nย่อหน้า 1: a\n\nPossibly relevant: 1\nPreliminary answer: x\n\nQuestion: q"


def test_stream_scores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"system":"s","query_id":"q","answer":"x","refs":["P1"]}\n')
    gold = spark.createDataFrame([("q", ["P1", "P2"])], "query_id string, gold array<string>")
    seen = []
    listener = scoring.Progress(lambda _, n: seen.append(n))
    spark.streams.addListener(listener)
    detail = scoring.scored(scoring.arriving(spark, str(tmp_path / "in")), gold)
    scoring.write_batches(detail, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    spark.streams.removeListener(listener)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.first().iou == 0.5
    assert scoring.running_means(out).first().n == 1


def test_scores_need_one_shuffle_of_documents(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = evidence.evidence(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_large_tables_of_texts_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(evidence, "SPREAD_BYTES", 0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert "Exchange" not in plan(evidence.evidence(d))
    fused = plan(evidence.methods(evidence.evidence(d)))
    assert fused.count("Exchange") == 1 and not re.search(r"Exchange[^\n]*\n[^\n]*text#", fused)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_index_percentile_counts_values_before_it_sorts(spark, share):
    groups = {"a": [3, 1, 1, 1, None, 2, 2, 9], "b": [5], "c": [None], None: [4, 4, 7]}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "source string, n long")
    out = analysis.index_percentile(df, "n", ["source"], share)
    ordered = {g: sorted(xs, key=lambda x: (x is not None, x or 0)) for g, xs in groups.items()}
    assert sorted(map(repr, ((r.source, r.value) for r in out.collect()))) == sorted(repr((g, xs[min(int(share * len(xs)), len(xs) - 1)])) for g, xs in ordered.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("_bin#" in x for x in plan.split("\n") if "windowspecdefinition" in x and "n#" in x.partition("ASC")[0].rpartition(",")[2])


def test_words_keep_their_marks(spark):
    rows = spark.createDataFrame([("ที่น้ำ ไหล",), ("end.Next\tword",), ("É é-x_y 1,5",), ("...",), (None,)], "t string")
    got = [r.w for r in rows.select(text.words(F.col("t")).alias("w")).collect()]
    assert got == [["ที่น้ำ", "ไหล"], ["end", "next", "word"], ["é", "é", "x", "y", "1", "5"], [], None]
    spaced = rows.select(text.words_and_spaces(F.col("t")).alias("w")).first().w
    assert spaced == ["ที่น้ำ", " ", "ไหล"]


def test_every_document_with_a_word_is_asked(spark):
    rows = [(0, "one"), (1, "a\n...\nb c"), (2, "___"), (3, "x y z\nx y z")]
    e = evidence.evidence(docs(spark, rows))
    assert {(r.doc_id, r.n) for r in e.select("doc_id", "n").distinct().collect()} == {(0, 1), (1, 2), (3, 2)}
    assert {(r.doc_id, r.pos) for r in e.where("is_gold = 1").collect()} == {(0, 1), (1, 2), (3, 1), (3, 2)}


def test_another_tokenizer_can_be_put_in(spark):
    letters = lambda t: F.split(t, "(?!$)")
    e = evidence.evidence(docs(spark, [(0, "ab\nba")]), tokenize=letters).collect()
    assert [r.len for r in e] == [2, 2]


def test_ranks_and_run_lengths(spark):
    df = spark.createDataFrame([([0.5, 0.9, 0.5, -1.0], ["b", "a", "b"]), ([], [])], "s array<double>, w array<string>")
    got = df.select(evidence.ranks(F.col("s")).alias("r"), evidence.run_lengths(F.col("w")).alias("n")).collect()
    assert (got[0].r, got[0].n) == ([2, 1, 3, 4], [1, 2]) and (got[1].r, got[1].n) == ([], [])


def test_seams_for_models(spark):
    class Halves:
        def segment(self, texts):
            return [[t[: len(t) // 2], " ", t[len(t) // 2 :]] for t in texts]

    class Lengths:
        def logits(self, prompts):
            return [[len(p), 3.0] for p in prompts]

    df = spark.createDataFrame([("Abcd",), ("a b a",)], "t string")
    assert [r.w for r in df.select(inference.segmented(Halves)(F.col("t")).alias("w")).collect()] == [["ab", "cd"], ["a ", "b a"]]
    p = [r.p for r in df.select(inference.yes_no_scored(F.col("t"), Lengths).alias("p")).collect()]
    assert p == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.exp(-2))])
    v = df.select(inference.embedded_tokens(F.col("t")).alias("v")).collect()[1].v
    assert len(v) == 3 and v[0] == v[2] and sum(v[0]) == 1.0 and len(v[0]) == 64


def test_runs_of_different_questions_fail(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, gold int")
    p = spark.createDataFrame([(1, 1)], "doc_id long, predicted int")
    assert analysis.with_predictions(a.where("doc_id = 1"), p, "doc_id", "predicted").first().predicted == 1
    with pytest.raises(Exception, match="no prediction for 2"):
        analysis.with_predictions(a, p, "doc_id", "predicted").collect()


def test_vectors_of_any_width(spark):
    rows = [(i, i % 2, [float(i), 1.0, 0.0]) for i in range(50)]
    v = vectors.placed(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    got = {r.vec_id: r.centrality for r in vectors.centrality(v, "doc_id").collect()}
    assert got[0] == 1.0 and len(got) == 50
    assert vectors.blend_sweep(v, [0.0, 1.0]).count() == 2
