import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksheaf.functions import rouge, text
from ranksheaf.operators import logistic, pairs, pools

# -- best pairs


def brute_pairs(rows, k, within=False):
    out = []
    for a, b in itertools.combinations(sorted(r for r in rows if r[2] is not None and r[3] is not None), 2):
        if a[2] != b[2] and (a[0] == b[0]) == within:
            out.append((-(a[3] + b[3]), *a[:2], *b[:2]))
    return sorted(out)[:k]


@pytest.mark.parametrize("kind", ["ties", "one document holds the best", "one class holds the best", "few"])
@pytest.mark.parametrize("k", [1, 5])
def test_top_pairs_are_those_of_all(spark, kind, k):
    rng = random.Random(f"{kind}{k}")
    n = 4 if kind == "few" else 400
    rows = []
    for i in range(n):
        doc = 7 if kind == "one document holds the best" and i % 3 == 0 else rng.randrange(60)
        cls = "a" if kind == "one class holds the best" and i % 3 == 0 else rng.choice("abcdef")
        score = float(rng.randrange(4)) if kind == "ties" else rng.random() + (2 if i % 3 == 0 else 0)
        rows.append((doc, i, cls, score))
    rows += [(1, 9000, None, 9.0), (1, 9001, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, cls string, score double").repartition(4)
    got = [(-r.pair_score, r.doc_a, r.pos_a, r.doc_b, r.pos_b) for r in pairs.top_pairs(df, k).orderBy("rank").collect()]
    assert got == brute_pairs(rows, k)
    within = {}
    for r in pairs.top_pairs_within(df, k).orderBy("rank").collect():
        within.setdefault(r.doc_a, []).append((-r.pair_score, r.doc_a, r.pos_a, r.doc_b, r.pos_b))
    docs = {r[0] for r in rows}
    assert within == {d: p for d in docs if (p := brute_pairs([r for r in rows if r[0] == d], k, True))}


def test_top_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, pos long, cls string, score double")
    assert pairs.top_pairs(none, 5).count() == 0 and pairs.top_pairs_within(none, 5).count() == 0
    one = spark.createDataFrame([(i, i, "same", 1.0) for i in range(30)], "doc_id long, pos long, cls string, score double")
    assert pairs.top_pairs(one, 5).count() == 0


def test_few_candidates_are_joined(spark):
    df = spark.range(20_000).selectExpr("id % 500 AS doc_id", "id AS pos", "concat('c', id % 7) AS cls", "rand(3) AS score")
    out = pairs.top_pairs(df, 5)
    assert out.count() == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# -- logistic regression


def solved(x, y, l2=0.01):
    """The same optimum by plain gradient descent with many small steps, then Newton to its end."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mean) / deviation, np.ones(len(x))))
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], l2), 0]
    for i in range(400):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        g = z.T @ (p - y) / len(y) + penalty * w
        if i < 300:
            w -= 0.5 * g
        else:
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(penalty), g)
    return mean, deviation, w


@pytest.mark.parametrize("kind", ["mixed", "separable", "rare", "constant"])
def test_coefficients_are_a_solver_s(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [1, 50, 0.01] + [0, 1000, 5]
    y = (x[:, 0] + rng.normal(size=300) > 0.3).astype(int)
    if kind == "separable":
        y = (x[:, 0] > 0).astype(int)
    if kind == "rare":
        y = (np.arange(300) % 50 == 0).astype(int)
    if kind == "constant":
        x[:, 1] = 3.0
    fold = np.arange(300) % 3
    df = spark.createDataFrame([([float(v) for v in a], int(b), int(c)) for a, b, c in zip(x, y, fold, strict=True)], "features array<double>, label int, fold int").repartition(5)
    for k, m in enumerate(logistic.fitted(df.cache(), 3)):
        mean, deviation, w = solved(x[fold != k], y[fold != k])
        assert m.mean == pytest.approx(mean) and m.deviation == pytest.approx(deviation, rel=1e-6)
        assert m.weights == pytest.approx(w, abs=1e-6)
    whole = logistic.fitted(df, 1)[0]
    assert whole.weights == pytest.approx(solved(x, y)[2], abs=1e-6)
    got = {tuple(r.features): r.chance for r in df.withColumn("chance", whole.chance(F.col("features"))).collect()}
    mean, deviation, w = solved(x, y)
    for a in x[:20]:
        assert got[tuple(a)] == pytest.approx(1 / (1 + math.exp(-(((a - mean) / deviation) @ w[:-1] + w[-1]))), abs=1e-6)


def test_a_single_class_has_its_bias_at_the_bound(spark):
    df = spark.createDataFrame([([float(i)], int(i == 4), i % 2) for i in range(10)], "features array<double>, label int, fold int")
    one, two = logistic.fitted(df, 2)  # the only positive is in fold 0, so the first model sees none
    assert one.weights.tolist() == [0.0, -50.0] and abs(two.weights[1]) < 50


# -- caps


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_prefix_subsequences():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        whole = [rng.randrange(14) for _ in range(5)]
        tails = [rng.choice(["a", "z", None]) for _ in range(5)]
        want = [plain_lcs(a, b[:w] + ([t] if t is not None else [])) for w, t in zip(whole, tails, strict=True)]
        assert rouge.prefix_lcs(a, b, whole, tails) == want


def test_caps_score_as_cut_texts_do(spark):
    raw = ["One two, three-four  five", "", "  ...  ", "word", "Ärger über Öl 12.5 % und mehr " * 5, "a b c d e f g h"]
    gold = ["one three five", "x", "", "wo", "über öl und", "h g f e d c b a"]
    df = spark.createDataFrame(list(zip(range(6), raw, gold, strict=True)), "id long, raw string, g string").select("id", "raw", text.words(F.col("raw")).alias("found"), text.words(F.col("g")).alias("gold"))
    words, chars = [1, 2, 5, 100], [1, 3, 4, 7, 8, 1000]
    rows = {(r.id, r.unit, r.cap): r for r in rouge.capped_scores(df, "gold", "found", "raw", ["id"], words, chars, text.words).collect()}
    cuts = df.select("id", "gold", "found", F.array(*(text.words(F.substring("raw", 1, c)) for c in chars)).alias("cut")).collect()
    assert len(rows) == 6 * 11
    for r in cuts:
        cut = {("w", c): r.found[:c] for c in words} | {("c", c): r.cut[i] for i, c in enumerate(chars)} | {("none", 0): r.found}
        for (unit, cap), b in cut.items():
            n, size = plain_lcs(r.gold, b), len(r.gold) + len(b)
            x = rows[r.id, unit, cap]
            assert x.size == len(b) and x.rouge_l == pytest.approx(2 * n / size if size else 0.0)


def test_cut_content_words(spark):
    df = spark.createDataFrame([([" ", "a", "  ", "b", "\n", "c", " "],), ([],), (["a"],), ([" ", "\n"],)], "t array<string>")
    cut = lambda n: [r.c for r in df.select(text.cut_content_words(F.col("t"), n).alias("c")).collect()]
    assert cut(2) == ["a  b", "", "a", ""] and cut(3) == ["a  b\nc", "", "a", ""] and cut(1) == ["a", "", "a", ""]


# -- the citation model


def test_expected_iou_is_the_mean_over_all_draws(spark):
    rates = [0.8, 0.3, 0.2, 0.1, 0.1]
    gold = {1: [1, 0, 1, 0, 0, 1, 0], 2: [0, 0, 0], 3: [1]}
    rows = [(d, i + 1, i + 1, g, max(1, sum(gs)) + (d == 2)) for d, gs in gold.items() for i, g in enumerate(gs)]
    e = spark.createDataFrame(rows, "doc_id long, pos long, rd long, is_gold long, n_gold long")
    got = {r.doc_id: r for r in pools.expected_iou(e, rates, 6).collect()}
    for d, gs in gold.items():
        n_gold, total, mean_k = max(1, sum(gs)) + (d == 2), 0.0, 0.0
        p = [1.0 if i == 0 else rates[i] if i < 5 else max(0.05, rates[-1] * 0.8 ** (i - 4)) for i in range(len(gs[:6]))]
        for cited in itertools.product((0, 1), repeat=len(p)):
            chance = math.prod(q if c else 1 - q for c, q in zip(cited, p, strict=True))
            h = sum(c * g for c, g in zip(cited, gs, strict=False))
            total, mean_k = total + chance * h / (n_gold + sum(cited) - h), mean_k + chance * sum(cited)
        assert got[d].expected_iou == pytest.approx(total) and got[d].expected_k == pytest.approx(mean_k)
    cited = {(r.doc_id, r.rd): r.cited for r in pools.simulated_citations(e, rates).collect()}
    assert all(cited[d, 1] == 1 for d in gold)
