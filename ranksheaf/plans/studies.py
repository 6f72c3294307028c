"""Queries on prompts, runs, vectors, text studies, leaderboards and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sets, text
from ..operators import analysis, inference, pools, prompts, vectors
from ..operators import evidence as ev
from ..sources import corpus, scratch, sinks
from .oracle import ARRAYS, EVIDENCE, HEX, VECTORS, WORDS, over
from .registry import MIN_MAX, SETS, STATS, STRIPPED, SUMMARY, _detail, _evidence, _paragraphs, _sets, query, read

# -- prompts and runs


@query(over(ARRAYS, "SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg('[' || pos || '] ' || text, chr(10) ORDER BY pos) AS context FROM paras GROUP BY doc_id"))
def prompt_context(spark, sf_dir):
    return prompts.contexts(_paragraphs(spark, sf_dir), ["doc_id"]).select("doc_id", F.size("texts").cast("long").alias("n"), "context")


@query(
    over(
        "u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'), "
        "p AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS r FROM u LEFT JOIN a USING (conv_id, turn))",
        """SELECT conv_id, turn, CAST(CASE WHEN r IS NULL THEN 2 ELSE 4 END AS BIGINT) AS n_messages,
'system=Answer from the context and cite paragraphs as [อ้างอิง: numbers].' || chr(10) || CASE WHEN r IS NULL THEN '' ELSE 'user=' || q || chr(10) || 'assistant=' || r || chr(10) END || 'user=' || q AS chat FROM p""",
    )
)
def chat_messages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    system = prompts.INSTRUCTIONS["cite"]
    shots = F.array_compact(F.array(F.when(F.col("r").isNotNull(), F.struct(F.col("q").alias("question"), F.col("r").alias("answer")))))
    m = u.join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", prompts.chat(system, F.col("q"), prompts.shot_turns(shots)).alias("m"))
    return m.select("conv_id", "turn", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "\n").alias("chat"))


HINTED = over(
    EVIDENCE
    + """, h AS (SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ', ' ORDER BY pos) FILTER (rd <= 3 AND dense > 0.2) AS hint FROM evidence GROUP BY doc_id),
c AS (SELECT doc_id, string_agg('[' || pos || '] ' || text, chr(10) ORDER BY pos) AS context FROM paras GROUP BY doc_id)""",
    "SELECT h.doc_id, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Focus on: ' || coalesce(hint, '—') || chr(10) || chr(10) || 'Question: ' || array_to_string(k.q, ' ') AS prompt FROM h JOIN c USING (doc_id) JOIN asked k USING (doc_id)",
)


@query(HINTED)
def hint_prompt(spark, sf_dir):
    """The whole document's paragraphs, the places of the best ones and the question, put together within the document's row."""
    d = ev.scored(read(spark, sf_dir, "documents"))
    best = F.filter("s", lambda x: (x["rd"] <= 3) & (x["dense"] > 0.2))
    places = F.transform(best, lambda x: (x["pos"] - 1).cast("int"))
    return d.select("doc_id", prompts.context_first(prompts.numbered(F.col("ps")), F.array_join("q", " "), F.concat(F.lit("Focus on: "), prompts.hint(places))).alias("prompt"))


@query(HINTED)
def hint_prompt_full(spark, sf_dir):
    """The same prompts from the prompt builder's tables: contexts and evidence joined by document."""
    context = prompts.contexts(_paragraphs(spark, sf_dir), ["doc_id"]).select("doc_id", "context")
    e = _evidence(spark, sf_dir)
    h = e.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when((F.col("rd") <= 3) & (F.col("dense") > 0.2), (F.col("pos") - 1).cast("int")))).alias("idx"))
    q = ev.questioned(read(spark, sf_dir, "documents")).select("doc_id", F.array_join("q", " ").alias("q"))
    rows = h.join(q, "doc_id").join(context, "doc_id")
    return rows.select("doc_id", prompts.context_first(F.col("context"), F.col("q"), F.concat(F.lit("Focus on: "), prompts.hint(F.col("idx")))).alias("prompt"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs per question: the dense and the BM25 first paragraph as the answer, their top 3 as evidence."""
    d = ev.scored(read(spark, sf_dir, "documents"))
    ids = lambda kept: F.transform(kept, lambda x: F.concat(F.lit("P"), x["pos"].cast("string")))
    upto = lambda r, k: ids(F.filter("s", lambda x: x[r] <= k))
    run = lambda name, r: F.struct(F.lit(name).alias("run"), F.get(upto(r, 1), F.lit(0)).alias("answer"), F.array_sort(upto(r, 3)).alias("refs"))
    return d.select(F.col("doc_id").alias("query_id"), F.inline(F.array(run("A", "rd"), run("B", "rb"))))


RUNS = EVIDENCE + """, runs AS (
  SELECT doc_id AS query_id, 'A' AS run, max('P' || pos) FILTER (rd = 1) AS answer, list_sort(list('P' || pos) FILTER (rd <= 3)) AS refs FROM evidence GROUP BY doc_id
  UNION ALL SELECT doc_id, 'B', max('P' || pos) FILTER (rb = 1), list_sort(list('P' || pos) FILTER (rb <= 3)) FROM evidence GROUP BY doc_id)"""


@query(over(RUNS, "SELECT a.query_id, b.answer, array_to_string(a.refs, ',') AS refs FROM runs a JOIN runs b USING (query_id) WHERE a.run = 'A' AND b.run = 'B'"))
def column_merge(spark, sf_dir):
    r = scratch.stored(_runs(spark, sf_dir))
    return inference.merged(r.where("run = 'B'"), r.where("run = 'A'")).select("query_id", "answer", F.array_join("refs", ",").alias("refs"))


@query(over(RUNS, "SELECT a.query_id, 'ans' || a.run || '_ref' || b.run AS combo, a.answer, array_to_string(b.refs, ',') AS refs FROM runs a JOIN runs b USING (query_id)"))
def combo_grid(spark, sf_dir):
    return inference.combinations(_runs(spark, sf_dir)).select("query_id", "combo", "answer", F.array_join("refs", ",").alias("refs"))


@query(
    over(
        ARRAYS + ", l AS (SELECT doc_id FROM labels), b AS (SELECT doc_id FROM arrays WHERE n >= 5)",
        "SELECT count(*) FILTER (l.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both, count(*) FILTER (b.doc_id IS NULL) AS only_a, count(*) FILTER (l.doc_id IS NULL) AS only_b FROM l FULL JOIN b ON l.doc_id = b.doc_id",
    )
)
def hybrid_assert(spark, sf_dir):
    """How the keys of two runs differ: what a merge by key would assert to be zero."""
    a = read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("a"))
    b = ev.paragraph_arrays(read(spark, sf_dir, "documents")).where(F.col("n") >= 5).select("doc_id", F.lit(1).alias("b"))
    both = a.join(b, "doc_id", "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


@query(
    over(
        EVIDENCE + """, c AS (SELECT doc_id, pos, dense >= 0.3 AND rd <= 3 AS cited FROM evidence), k AS (SELECT *, bool_or(cited) OVER (PARTITION BY doc_id) AS any_cited FROM c)""",
        "SELECT doc_id, pos FROM k WHERE CASE WHEN any_cited THEN cited ELSE pos <= 5 END",
    )
)
def stage_filter_context(spark, sf_dir):
    e = scratch.stored(_evidence(spark, sf_dir).select("doc_id", "pos", F.concat(F.lit("P"), "pos").alias("para_id"), "dense", "rd"))
    return prompts.kept_by_citation(e, e.where("dense >= 0.3 AND rd <= 3"), ["doc_id"]).select("doc_id", "pos")


STUB = EVIDENCE + r""", h AS (
  SELECT doc_id, ps, list_transform(range(1, len(ps) + 1), lambda i: len(list_intersect(list_distinct(q), list_distinct(string_split_regex(lower('[' || i || '] ' || ps[i]), '\s+'))))) AS n FROM asked),
first AS (SELECT doc_id, ps, n, list_position(n, list_max(n)) AS b1, len(n) + 1 - list_position(list_reverse(n), list_max(n)) AS b2 FROM h)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, query, para_ids, texts, put together within the document's row."""
    d = ev.questioned(ev.spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.transform("ps", lambda p, i: F.concat(F.lit("P"), (i + 1).cast("string")))
    return d.select(F.col("doc_id").alias("query_id"), "doc_id", F.array_join("q", " ").alias("query"), ids.alias("para_ids"), F.col("ps").alias("texts"))


def said(place: str) -> str:
    return STRIPPED.format(f"ps[{place}]")


@query(over(STUB, f"SELECT doc_id, {said('b1')} AS answer, 'P' || b1 AS refs, true AS explicit FROM first"))
def generate_stub(spark, sf_dir):
    """Prompts through the stand-in generator and the parser, document by document."""
    c = _asked(spark, sf_dir).withColumn("prompt", prompts.context_first(prompts.numbered(F.col("texts")), F.col("query")))
    out = inference.parsed(inference.generated(c.select("doc_id", "query", "para_ids", "texts", "prompt")))
    return out.select("doc_id", "answer", F.array_join("refs", ",").alias("refs"), "explicit")


@query(over(STUB, f"SELECT doc_id AS query_id, {said('b1')} AS answer1, 'P' || b1 AS refs1, {said('b1')} AS answer2, 'P' || b1 AS refs2 FROM first"))
def two_stage_hint(spark, sf_dir):
    """Two stages of the stand-in generator, the second with the first's evidence as a hint."""
    out = inference.two_stage(_asked(spark, sf_dir), "hint_fixed")
    return out.select("query_id", "answer1", F.array_join("refs1", ",").alias("refs1"), "answer2", F.array_join("refs2", ",").alias("refs2"))


@query(over(STUB, " UNION ALL ".join(f"SELECT doc_id AS query_id, 's{a}ans_s{r}ref' AS combo, {said(f'b{a}')} AS answer, 'P' || b{r} AS refs FROM first" for a in (1, 2) for r in (1, 2))))
def hint_grid(spark, sf_dir):
    """Evidence and answer of the first stage as a hint for a second model, and all four pairs of their answers and evidence."""
    out = inference.two_stage(_asked(spark, sf_dir), "hint_both", second=lambda: inference.ExtractiveGenerator(last=True))
    return inference.stage_combinations(out).select("query_id", "combo", "answer", F.array_join("refs", ",").alias("refs"))


@query(
    over(
        EVIDENCE
        + f""", cached AS (SELECT doc_id, pos, dense AS score FROM evidence WHERE {HEX.format("doc_id || ':' || pos", 1, 2)} < 200),
f AS (SELECT e.doc_id, e.pos, coalesce(c.score, CASE WHEN e.bm25 > 0 THEN e.bm25 END, -1e9) AS score FROM evidence e LEFT JOIN cached c ON e.doc_id = c.doc_id AND e.pos = c.pos)""",
        "SELECT doc_id, pos, round(score, 6) AS score FROM f",
    )
)
def rerank_fallback_join(spark, sf_dir):
    """Cached pair scores where there are some, live ones else, the lowest as a last resort."""
    e = scratch.stored(_evidence(spark, sf_dir).select("doc_id", "pos", "dense", "bm25"))
    keep = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "pos")), 1, 2), 16, 10).cast("int") < 200
    cached = e.where(keep).select("doc_id", "pos", F.col("dense").alias("score"))
    return inference.with_scores(e, cached, ["doc_id", "pos"], F.when(F.col("bm25") > 0, F.col("bm25"))).select("doc_id", "pos", F.round("score", 6).alias("score"))


@query(
    over(
        EVIDENCE
        + """, q AS (SELECT doc_id, max(CASE WHEN rd = 1 THEN is_gold END) AS was, max(CASE WHEN rb = 1 THEN is_gold END) AS now, (doc_id % 17 = 0) AS failed FROM evidence GROUP BY doc_id)""",
        """SELECT CASE WHEN was = 1 THEN 'hit' ELSE 'failure' END AS label,
CASE WHEN failed THEN 'parse_fail' WHEN was = 0 AND now = 1 THEN 'recovered' WHEN was = 0 THEN 'still_wrong' WHEN now = 1 THEN 'kept' ELSE 'broke' END AS outcome, count(*) AS n FROM q GROUP BY ALL""",
    )
)
def llm_rerank_outcomes(spark, sf_dir):
    """What a second opinion (here BM25's first) does to the dense first: outcome counts per label."""
    e = _evidence(spark, sf_dir)
    q = e.groupBy("doc_id").agg(F.max(F.when(F.col("rd") == 1, F.col("is_gold"))).alias("was"), F.max(F.when(F.col("rb") == 1, F.col("is_gold"))).alias("now"))
    was, now = F.col("was") == 1, F.col("now") == 1
    out = F.when(F.col("doc_id") % 17 == 0, "parse_fail").when(~was & now, "recovered").when(~was, "still_wrong").when(now, "kept").otherwise("broke")
    return q.groupBy(F.when(was, "hit").otherwise("failure").alias("label"), out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# -- vectors


PAIRS = VECTORS + """, pairs AS (
  SELECT a.doc_id, a.vec_id AS query_id, b.vec_id, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS is_gold, round(list_dot_product(a.v, b.v), 9) AS score
  FROM vectors a JOIN vectors b ON a.doc_id = b.doc_id AND a.vec_id <> b.vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"""


@query(over(PAIRS, "SELECT query_id, vec_id, rank, round(score, 6) AS score, CAST(is_gold AS BIGINT) AS is_gold FROM rk WHERE rank <= 3"))
def dense_cosine_matrix_topk(spark, sf_dir):
    r = vectors.within_documents(vectors.placed(read(spark, sf_dir, "embeddings"))).where("rank <= 3")
    return r.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"), "is_gold")


BLENDS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(
    over(
        VECTORS
        + f""", al AS (SELECT CAST(unnest({BLENDS}) AS DOUBLE) AS alpha),
dims AS (SELECT doc_id, i, avg(v[i]) AS x FROM (SELECT doc_id, v, unnest(generate_series(1, 64)) AS i FROM vectors) GROUP BY doc_id, i),
means AS (SELECT doc_id, list(x ORDER BY i) AS h FROM dims GROUP BY doc_id),
q0 AS (SELECT alpha, doc_id, vec_id AS query_id, label, list_transform(list_zip(v, h), lambda z: (1 - alpha) * z[1] + alpha * z[2]) AS q FROM vectors JOIN means USING (doc_id), al),
q1 AS (SELECT *, sqrt(list_dot_product(q, q)) AS len FROM q0),
s AS (SELECT alpha, query_id, b.vec_id, q1.label = b.label AS gold, round(list_dot_product(q, b.v) / CASE WHEN len = 0 THEN 1 ELSE len END, 7) AS score FROM q1 JOIN vectors b ON q1.doc_id = b.doc_id AND q1.query_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, vec_id) AS rank FROM s),
per AS (SELECT alpha, query_id, max(CASE WHEN gold AND rank = 1 THEN 1.0 ELSE 0.0 END) AS hit1, coalesce(1.0 / min(CASE WHEN gold THEN rank END), 0) AS mrr FROM r GROUP BY alpha, query_id)""",
        "SELECT alpha, count(*) AS n, round(avg(hit1), 4) AS hit1, round(avg(mrr), 4) AS mrr FROM per GROUP BY alpha",
    )
)
def hyde_blend_sweep(spark, sf_dir):
    return vectors.blend_sweep(vectors.placed(read(spark, sf_dir, "embeddings")), BLENDS)


@query(
    over(
        VECTORS
        + """, p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v), 9) AS score FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.doc_id <> b.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)""",
        "SELECT query_id, vec_id, rank, round(score, 6) AS score FROM k WHERE rank <= 2",
    )
)
def knn_fewshot(spark, sf_dir):
    return vectors.nearest(vectors.placed(read(spark, sf_dir, "embeddings")), 2).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(over(VECTORS, "SELECT a.vec_id, a.doc_id, round(coalesce(avg(list_dot_product(a.v, b.v)), 0), 6) AS centrality FROM vectors a LEFT JOIN vectors b ON a.doc_id = b.doc_id AND a.vec_id <> b.vec_id GROUP BY a.vec_id, a.doc_id"))
def centrality(spark, sf_dir):
    return vectors.centrality(vectors.placed(read(spark, sf_dir, "embeddings")), "doc_id")


# -- text studies

CLASSES_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in text.QUESTION_CLASSES) + " ELSE 'other' END"


@query(over(ARRAYS, f"SELECT doc_id, pos, {CLASSES_SQL} AS qtype, regexp_matches(text, '\\p{{Nd}}') AS has_digit FROM paras"))
def qtype_classify(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", text.question_class(F.col("text")).alias("qtype"), text.has_digit(F.col("text")).alias("has_digit"))


FORM = f""", f AS (
  SELECT p.doc_id, p.pos, p.text, len(list_filter(p.tokens[1:5], lambda t: list_contains(d.ts[1][1:5], t))) / 5.0 AS restate,
         1.0 / (1.0 + abs(len(p.tokens) - 28.0) / 28.0) AS length FROM paras p JOIN arrays d ON p.doc_id = d.doc_id)"""


def _form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each paragraph restates its document's first one, and how close it is to 28 words."""
    a = ev.paragraph_arrays(read(spark, sf_dir, "documents"))
    rows = a.select("doc_id", F.get("ts", F.lit(0)).alias("head"), F.posexplode(F.arrays_zip("ps", "ts")).alias("i", "p"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("p.ps").alias("text"), text.restate_score(F.col("p.ts"), F.col("head")).alias("restate"), text.length_score(F.size("p.ts"), 28.0).alias("length"))


@query(over(ARRAYS + FORM, "SELECT doc_id, pos, round(restate, 6) AS restate, round(length, 6) AS length FROM f"))
def restate_score(spark, sf_dir):
    return _form(spark, sf_dir).select("doc_id", "pos", F.round("restate", 6).alias("restate"), F.round("length", 6).alias("length"))


@query(
    over(
        ARRAYS + FORM + f""", c AS (SELECT doc_id, pos, {CLASSES_SQL} AS qtype, round(0.4 * restate + 0.3 * length, 9) AS score FROM f),
b AS (SELECT doc_id, qtype, max(score) AS score, arg_min(pos, (-score, pos)) AS pos FROM c GROUP BY doc_id, qtype)""",
        "SELECT a.doc_id, a.pos AS pos_a, b.pos AS pos_b, round(a.score + b.score, 6) AS score FROM b a JOIN b ON a.doc_id = b.doc_id AND a.qtype < b.qtype",
    )
)
def diverse_pairs(spark, sf_dir):
    """Pairs of a document's best candidates of different classes: at most one candidate a class is paired."""
    c = _form(spark, sf_dir).select("doc_id", "pos", text.question_class(F.col("text")).alias("qtype"), F.round(0.4 * F.col("restate") + 0.3 * F.col("length"), 9).alias("score"))
    best = c.groupBy("doc_id", "qtype").agg(F.max("score").alias("score"), F.min_by("pos", F.struct(-F.col("score"), F.col("pos"))).alias("pos"))
    a, b = (best.select("doc_id", *(F.col(x).alias(f"{x}_{s}") for x in ("qtype", "score", "pos"))) for s in ("a", "b"))
    return a.join(b, "doc_id").where("qtype_a < qtype_b").select("doc_id", "pos_a", "pos_b", F.round(F.col("score_a") + F.col("score_b"), 6).alias("score"))


EDGES = [0.0, 20.0, 40.0, 60.0, 100.0, 200.0, 400.0, 1000000.0]


@query(
    over(
        ARRAYS + f", b AS (SELECT i - 1 AS bin, {EDGES}[i] AS low, {EDGES}[i + 1] AS high FROM (SELECT unnest(generate_series(1, 7)) AS i))",
        """SELECT b.bin, CAST(b.low AS DOUBLE) AS low, CAST(b.high AS DOUBLE) AS high, count(p.doc_id) AS n, round(avg(length(p.text)), 6) AS mean_chars
FROM b LEFT JOIN paras p ON len(p.tokens) >= b.low AND len(p.tokens) < b.high GROUP BY ALL""",
    )
)
def length_buckets(spark, sf_dir):
    p = _paragraphs(spark, sf_dir).select(F.size("tokens").alias("n_tokens"), F.length("text").alias("n_chars"))
    return analysis.binned(p, F.col("n_tokens"), EDGES, [F.round(F.avg("n_chars"), 6).alias("mean_chars")])


@query(over(ARRAYS, "SELECT d.lang, count(*) AS n, round(corr(len(p.tokens), length(p.text)), 6) AS r FROM paras p JOIN documents d ON p.doc_id = d.doc_id GROUP BY d.lang"))
def length_correlation(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), text.is_valid_paragraph)
    rows = docs.select("lang", F.explode(lines).alias("p")).select("lang", F.size(text.words(F.col("p"))).cast("double").alias("a"), F.length("p").cast("double").alias("b"))
    return analysis.correlation(rows, "a", "b", ["lang"])


@query(f"SELECT source, {STATS.format(c='n_chars')} FROM documents GROUP BY source")
def percentile_report(spark, sf_dir):
    return analysis.percentiles(read(spark, sf_dir, "documents"), "n_chars", ["source"])


@query("SELECT source, n_chars AS value FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn = least(floor(0.9 * n) + 1, n)")
def index_percentile(spark, sf_dir):
    return analysis.index_percentile(read(spark, sf_dir, "documents"), "n_chars", ["source"], 0.9)


BUDGETS = [256, 512, 1024, 2048, 4096, 8192, 16384]


@query(f"SELECT CAST(b AS BIGINT) AS budget, count(*) FILTER (n_chars > b) AS over, count(*) AS n FROM documents, (SELECT unnest({BUDGETS}) AS b) GROUP BY b")
def budget_over(spark, sf_dir):
    return analysis.over_budgets(read(spark, sf_dir, "documents").select("n_chars"), "n_chars", BUDGETS)


@query(over(ARRAYS, "SELECT doc_id, pos, array_to_string(tokens[1:12], ' ') AS cut FROM paras"))
def truncate_words(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", text.truncate_words(F.col("tokens"), 12).alias("cut"))


@query(over(ARRAYS, "SELECT doc_id, pos, CASE WHEN length(text) > 80 THEN rtrim(substring(text, 1, 80)) || '...' ELSE text END AS cut FROM paras"))
def truncate_chars(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", text.truncate_chars(F.col("text"), 80, "...").alias("cut"))


CAPS = [5, 10, 20, 40]


@query(
    over(
        EVIDENCE
        + f""", c AS (SELECT unnest({CAPS}) AS cap),
top AS (SELECT e.doc_id, p.toks AS t, p.q FROM evidence e JOIN ptoks p ON e.doc_id = p.doc_id AND e.pos = p.pos WHERE e.rd = 1),
s AS (SELECT cap, doc_id, len(list_filter(list_distinct(q), lambda x: list_contains(t[1:cap], x))) / CAST(len(list_distinct(q)) AS DOUBLE) AS kept, least(len(t), cap) AS size FROM top, c)""",
        "SELECT CAST(cap AS BIGINT) AS cap, count(*) AS n, round(avg(kept), 6) AS kept, round(avg(size), 6) AS mean_size FROM s GROUP BY cap",
    )
)
def cap_sweep(spark, sf_dir):
    """How much of the question the first paragraph still holds when it is cut to so many words."""
    d = ev.scored(read(spark, sf_dir, "documents"))
    first = F.get("ts", (F.array_position(F.col("s.rd"), F.lit(1).cast("long")) - 1).cast("int"))
    rows = pools.with_parameter(ev.stage(d, ["q"], t=first), "cap", CAPS)
    asked = F.array_distinct("q")
    cut = F.slice("t", F.lit(1), F.col("cap"))
    s = rows.select("cap", (F.size(F.array_intersect(asked, cut)) / F.size(asked)).alias("kept"), F.least(F.size("t"), F.col("cap")).alias("size"))
    return s.groupBy(F.col("cap").cast("long").alias("cap")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("kept"), 6).alias("kept"), F.round(F.avg("size"), 6).alias("mean_size"))


# -- classification of labelled documents

FEATURE = "CAST(length(regexp_replace(text, '[^%&$#*!|]', '', 'g')) AS DOUBLE) / greatest(length(text), 1)"
LABELLED = f"x AS (SELECT l.doc_id, 1 - l.quality AS y, d.lang, {FEATURE} AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y (1: low quality), lang, s (share of symbols)."""
    s = F.length(F.regexp_replace("text", "[^%&$#*!|]", "")).cast("double") / F.greatest(F.length("text"), F.lit(1))
    # measured where the text is read: the join moves numbers only
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", s.alias("s"), "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", (1 - F.col("quality")).cast("long").alias("y"), "lang", "s", "n_chars")


@query(
    over(
        LABELLED
        + """, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM x),
a AS (SELECT lang, sum(y) AS p, count(*) - sum(y) AS n, sum(CASE WHEN y = 1 THEN rk END) AS ranks FROM r GROUP BY lang),
b AS (SELECT *, coalesce((ranks - p * (p + 1) / 2.0) / nullif(CAST(p * n AS DOUBLE), 0), 0.5) AS auc FROM a)""",
        "SELECT lang, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives, round(greatest(auc, 1 - auc), 6) AS auc FROM b",
    )
)
def auc_ranksum(spark, sf_dir):
    return analysis.rank_sum_auc(_labelled(spark, sf_dir), "s", "y", ["lang"])


@query(
    over(
        LABELLED
        + """, c AS (SELECT i - 1 AS i, (SELECT quantile_cont(s, CAST(round(0.05 * i, 2) AS DOUBLE)) FROM x) AS cut FROM (SELECT unnest(generate_series(1, 19)) AS i)),
g AS (SELECT c.i, c.cut, u.above, x.y = 1 AS truth, CASE WHEN u.above THEN x.s > c.cut ELSE x.s <= c.cut END AS yes FROM x, c, (SELECT unnest([true, false]) AS above) u),
k AS (SELECT i, cut, above, count(*) FILTER (truth AND yes) AS tp, count(*) FILTER (NOT truth AND yes) AS fp, count(*) FILTER (truth AND NOT yes) AS fn, count(*) FILTER (NOT truth AND NOT yes) AS tn FROM g GROUP BY ALL)""",
        "SELECT round(cut, 6) AS cut, above, tp, fp, fn, tn, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy FROM k ORDER BY accuracy DESC, i, above DESC LIMIT 1",
    ).replace("(SELECT quantile_cont(s, CAST(round(0.05 * i, 2) AS DOUBLE)) FROM x) AS cut FROM (SELECT unnest(generate_series(1, 19)) AS i)", "qs[i] AS cut FROM (SELECT unnest(generate_series(1, 19)) AS i), (SELECT quantile_cont(s, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS qs FROM x)")
)
def best_threshold(spark, sf_dir):
    return analysis.best_threshold(_labelled(spark, sf_dir), "s", "y").select(F.round("cut", 6).alias("cut"), "above", "tp", "fp", "fn", "tn", "accuracy")


@query(
    over(
        LABELLED + ", k AS (SELECT count(*) FILTER (y = 1 AND s > 0.05) AS tp, count(*) FILTER (y = 0 AND s > 0.05) AS fp, count(*) FILTER (y = 1 AND s <= 0.05) AS fn, count(*) FILTER (y = 0 AND s <= 0.05) AS tn FROM x)",
        "SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM k",
    )
)
def confusion(spark, sf_dir):
    k = _labelled(spark, sf_dir).agg(*analysis.confusion(F.col("y") == 1, F.col("s") > 0.05))
    return k.select("tp", "fp", "fn", "tn", *analysis.rates(F.col("tp"), F.col("fp"), F.col("fn")))


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return inference.seeded_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, "42")


# -- leaderboards

BOARD = EVIDENCE + f""", det AS (
  SELECT d.system || '/' || x.lang AS system, d.rouge_l, d.ss, d.iou FROM detail d JOIN documents x ON d.doc_id = x.doc_id),
board AS (SELECT system, {SUMMARY} FROM det GROUP BY system),
computed AS (SELECT system, composite FROM board WHERE system <> 'rrf/es'),
stored AS (
  SELECT system, round(composite + CASE WHEN system LIKE '%/fr' THEN 0.01 ELSE 0 END, 4) AS stored, system LIKE 'bm25/%' AS has_fixed FROM board WHERE system <> 'dense/de')"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system per method and language."""
    d = _detail(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return analysis.summary(d.withColumn("system", F.concat_ws("/", "system", "lang")), ["system"])


@query(
    over(
        BOARD,
        """SELECT system, CASE split_part(system, '/', 1) WHEN 'dense' THEN 'hash' WHEN 'bm25' THEN 'okapi' ELSE '?' END AS model,
CASE WHEN coalesce(has_fixed, false) AND stored IS NOT NULL THEN 'fixed' WHEN composite IS NOT NULL THEN 'detail' ELSE 'stored' END AS source,
round(CASE WHEN NOT (coalesce(has_fixed, false) AND stored IS NOT NULL) AND composite IS NOT NULL THEN composite ELSE stored END, 4) AS composite,
CASE WHEN abs(composite - stored) > 0.0005 THEN 'disagrees' ELSE '' END AS flag
FROM computed FULL JOIN stored USING (system)""",
    )
)
def leaderboard_reconcile(spark, sf_dir):
    """Means of details against stored scores, some of which are missing, fixed or off."""
    board = scratch.stored(_board(spark, sf_dir))
    off = F.when(F.col("system").endswith("/fr"), 0.01).otherwise(0.0)
    stored = board.where("system <> 'dense/de'").select("system", F.round(F.col("composite") + off, 4).alias("stored"), F.col("system").startswith("bm25/").alias("has_fixed"))
    names = corpus.literal_table(spark, [("dense", "hash"), ("bm25", "okapi")], "method string, model string")
    labels = board.select("system", F.substring_index("system", "/", 1).alias("method")).join(names, "method").select("system", "model")
    return analysis.reconciled(board.where("system <> 'rrf/es'").select("system", "composite"), stored, labels)


@query(
    over(
        BOARD,
        """SELECT system, row_number() OVER (ORDER BY composite DESC, system) AS by_composite, row_number() OVER (ORDER BY answer_sub DESC, system) AS by_answer,
row_number() OVER (ORDER BY iou DESC, system) AS by_evidence FROM board""",
    )
)
def leaderboard_three_sorts(spark, sf_dir):
    order = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "system")).cast("long")
    return _board(spark, sf_dir).select("system", order("composite").alias("by_composite"), order("answer_sub").alias("by_answer"), order("iou").alias("by_evidence"))


# -- file formats


@query(over(ARRAYS, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, para_id, CAST(pos AS BIGINT) AS pos, text FROM paras"))
def corpus_round_trip(spark, sf_dir):
    """Nested corpus documents written as JSON and read back into paragraphs."""
    a = ev.paragraph_arrays(read(spark, sf_dir, "documents")).where("n > 0")
    named = F.transform("ps", lambda p, i: F.struct(F.concat(F.lit("P"), (i + 1).cast("string")).alias("para_id"), p.alias("text")))
    path = scratch.folder(spark)
    a.select(F.array(F.struct(F.col("doc_id").cast("string").alias("doc_id"), named.alias("paragraphs"))).alias("docs")).write.json(path)
    return corpus.paragraphs(spark.read.schema(corpus.CORPUS).json(path)).where("is_valid").select("doc_id", "para_id", F.col("pos").cast("long").alias("pos"), "text")


@query(over(SETS, "SELECT CAST(doc_id AS VARCHAR) AS query_id, d.text AS answer, array_to_string(list_sort(dense3), ',') AS refs, CAST(len(dense3) AS BIGINT) AS n_refs FROM picked JOIN documents d USING (doc_id)"))
def submission_round_trip(spark, sf_dir):
    """A submission with line breaks and quotes in its answers, written as CSV and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    p = _sets(spark, sf_dir).join(docs, "doc_id").select(F.col("doc_id").cast("string").alias("query_id"), F.col("doc_id").alias("query_ord"), F.col("text").alias("answer"), F.col("dense3").alias("refs"))
    path = scratch.folder(spark)
    sinks.write_submission(p, path)
    return corpus.read_submission(spark, path).select("query_id", "answer", F.array_join(F.array_sort("refs"), ",").alias("refs"), F.size("refs").cast("long").alias("n_refs"))


@query(
    "SELECT CAST(conv_id AS VARCHAR) || ':' || turn AS query_id, CASE WHEN turn % 3 = 0 THEN 'P' || turn WHEN turn % 3 = 1 THEN 'P1,P' || turn ELSE '' END AS refs FROM conversations"
)
def refs_coercion(spark, sf_dir):
    """Evidence given as a string, a list or null in JSON, as a list of ids."""
    c = read(spark, sf_dir, "conversations")
    ref = F.concat(F.lit("P"), F.col("turn").cast("string"))
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"'), ref, F.lit('"'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('["P1","'), ref, F.lit('"]'))).otherwise(F.lit("null"))
    rows = c.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), sets.as_list(F.parse_json(raw)).alias("refs"))
    return rows.select("query_id", F.array_join("refs", ",").alias("refs"))
