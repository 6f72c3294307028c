"""Further queries: yes/no reranking, three-list pools, vector caches, chat templates, run reports, rule predictors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rouge, text
from ..operators import analysis, inference, pools, prompts
from ..operators import evidence as ev
from ..operators.vectors import hashed_token_vectors
from ..sources import corpus, scratch, sinks
from .oracle import ARRAYS, EVIDENCE, HEX, SPACED, over
from .registry import LCS, TAGGED, TAG_RE, TOKENS_AS_BUCKETS, _answers, _evidence, query, read
from .studies import FORM, LABELLED, _form, _labelled

LATE = EVIDENCE + f""", sims AS (
  SELECT doc_id, pos, list_sum(list_transform({TOKENS_AS_BUCKETS.format('q')}, lambda a: coalesce(list_max(list_transform({TOKENS_AS_BUCKETS.format('toks')},
         lambda b: (CAST(a[1] = b[1] AS INT) + CAST(a[2] = b[2] AS INT)) / 2.0)), 0.0))) AS late FROM ptoks),
three AS (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY late DESC, e.pos) AS rl FROM evidence e JOIN sims s ON e.doc_id = s.doc_id AND e.pos = s.pos)"""


@query(over(LATE, "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN rd <= 5 THEN rd WHEN rb <= 5 THEN 5 + rb ELSE 10 + rl END) AS pool_pos FROM three WHERE least(rd, rb, rl) <= 5"))
def three_list_pool(spark, sf_dir):
    """Dense, BM25 and late interaction, each list's top 5, in that order."""
    return ev.ordered_union(ev.evidence(read(spark, sf_dir, "documents"), late=True), 5, ["rd", "rb", "rl"]).select("doc_id", "pos", "pool_pos")


@query(
    over(
        LATE + ", per AS (SELECT doc_id, n_gold, count(*) FILTER (least(rd, rb) <= 5 AND is_gold = 1) AS two, count(*) FILTER (least(rd, rb, rl) <= 5 AND is_gold = 1) AS three FROM three GROUP BY doc_id, n_gold)",
        "SELECT count(*) AS n, CAST(sum(n_gold) AS BIGINT) AS gold, CAST(sum(two) AS BIGINT) AS found_by_two, CAST(sum(three) AS BIGINT) AS found_by_three FROM per",
    )
)
def late_recall_ceiling(spark, sf_dir):
    """How much gold a third list adds to the pool of two."""
    e, gold = ev.evidence(read(spark, sf_dir, "documents"), late=True), F.col("is_gold") == 1
    per = e.groupBy("doc_id", "n_gold").agg(F.count_if(gold & (F.least("rd", "rb") <= 5)).alias("two"), F.count_if(gold & (F.least("rd", "rb", "rl") <= 5)).alias("three"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.sum("n_gold").alias("gold"), F.sum("two").alias("found_by_two"), F.sum("three").alias("found_by_three"))


@query(
    over(
        EVIDENCE
        + """, y AS (SELECT e.doc_id, e.pos, round(1.0 / (1.0 + exp(2.0 - 4.0 * e.dense)), 9) AS p,
    length('<Instruct>: ' || 'Does the paragraph answer the question?' || chr(10) || '<Query>: ' || array_to_string(a.q, ' ') || chr(10) || '<Document>: ' || a.ps[e.pos]) AS n_chars
  FROM evidence e JOIN asked a USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, pos) AS rank FROM y)""",
        "SELECT doc_id, pos, rank, round(p, 6) AS score, CAST(n_chars AS BIGINT) AS prompt_chars FROM k WHERE rank <= 5",
    )
)
def yes_no_rerank(spark, sf_dir):
    """The chance of yes against no per paragraph; stand-in logits (4 x dense similarity against 2) take a model's place."""
    d = ev.scored(read(spark, sf_dir, "documents"))
    prompt = lambda i: inference.yes_no_prompt("Does the paragraph answer the question?", F.array_join("q", " "), F.get("ps", i))
    chance = lambda x: ev.rounded(inference.yes_chance(4.0 * x["dense"], F.lit(2.0)))
    d = ev.stage(d, ["doc_id"], s=F.transform("s", lambda x, i: F.struct(x["pos"].alias("pos"), chance(x).alias("p"), F.length(prompt(i)).cast("long").alias("prompt_chars"))))
    d = ev.stage(d, ["doc_id", "s"], rank=ev.ranks(F.col("s.p"))).select("doc_id", F.inline(F.arrays_zip("s", "rank")))
    return d.where("rank <= 5").select("doc_id", "s.pos", "rank", F.round("s.p", 6).alias("score"), "s.prompt_chars")


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def vector_cache_round_trip(spark, sf_dir):
    """Vectors written to the cache's Parquet and read back."""
    path = scratch.folder(spark)
    sinks.write_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    v = corpus.read_vectors(spark, path, "vec_id long, embedding array<float>")
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.sqrt(squares), 5).alias("norm"))


@query(over(ARRAYS, f"SELECT doc_id, pos, CAST(len(tokens) AS BIGINT) AS n_vectors, CAST(coalesce(list_sum(list_transform({TOKENS_AS_BUCKETS.format('tokens')}, lambda v: v[1] + v[2])), 0) AS BIGINT) AS total FROM paras"))
def multi_vector_cache_round_trip(spark, sf_dir):
    """One vector a token and paragraph (here its two hash buckets), written to the multi-vector cache and read back."""
    path = scratch.folder(spark)
    p = ev.paragraphs(read(spark, sf_dir, "documents")).select("doc_id", "pos", F.transform(hashed_token_vectors(F.col("tokens")), lambda v: v.cast("array<float>")).alias("vectors"))
    sinks.write_vectors(p, path)
    v = corpus.read_vectors(spark, path, "doc_id long, pos long, vectors array<array<float>>")
    return v.select("doc_id", "pos", F.size("vectors").cast("long").alias("n_vectors"), F.aggregate(F.flatten("vectors"), F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"))


@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))) + length('<|im_start|>assistant' || chr(10)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def chat_template_length(spark, sf_dir):
    """How long each conversation is once it is laid out by the chat template, with the opening of the answer to come."""
    turn = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn.alias("m"))
    laid_out = prompts.laid_out(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    return c.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.length(laid_out).cast("long").alias("n_chars"))


@query(
    over(
        TAGGED + rf""", t AS (SELECT turn % 3 AS run, regexp_matches(raw, '{TAG_RE}') AS tagged, len(regexp_extract_all(raw, '{TAG_RE}')) AS tags, length(raw) AS size FROM answers)""",
        "SELECT CAST(run AS BIGINT) AS run, count(*) AS n, count(*) FILTER (tagged) AS tagged, round(avg(tags), 6) AS mean_tags, round(avg(size), 6) AS mean_chars, CAST(min(size) AS BIGINT) AS least, CAST(max(size) AS BIGINT) AS most FROM t GROUP BY run",
    )
)
def run_report(spark, sf_dir):
    """Per run: answers, those with a citation tag, tags an answer, sizes."""
    a = _answers(spark, sf_dir).withColumn("run", (F.col("turn") % 3).cast("long"))
    return analysis.run_report(a, "raw", ["run"])


@query(
    over(
        EVIDENCE + ", p AS (SELECT doc_id, count(*) AS size FROM evidence WHERE rd <= 10 OR rb <= 10 GROUP BY doc_id)",
        "SELECT count(*) AS n, round(avg(size), 6) AS mean_size, min(size) AS least, max(size) AS most FROM p",
    )
)
def pool_stats(spark, sf_dir):
    per = _evidence(spark, sf_dir).where("rd <= 10 OR rb <= 10").groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("size"), 6).alias("mean_size"), F.min("size").alias("least"), F.max("size").alias("most"))


@query(
    over(
        LABELLED.replace("d.lang,", "d.lang, d.n_chars,")
        + ", k AS (SELECT count(*) FILTER (y = 1 AND yes) AS tp, count(*) FILTER (y = 0 AND yes) AS fp, count(*) FILTER (y = 1 AND NOT yes) AS fn, count(*) FILTER (y = 0 AND NOT yes) AS tn FROM (SELECT y, s > 0.05 OR n_chars < 60 OR lang NOT IN ('en', 'de', 'fr', 'es') AS yes FROM x))",
        "SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM k",
    )
)
def or_rule(spark, sf_dir):
    """A predictor that says yes if any of its flags does, against the labels."""
    yes = analysis.any_of(F.col("s") > 0.05, F.col("n_chars") < 60, ~F.col("lang").isin("en", "de", "fr", "es"))
    k = _labelled(spark, sf_dir).agg(*analysis.confusion(F.col("y") == 1, yes))
    return k.select("tp", "fp", "fn", "tn", *analysis.rates(F.col("tp"), F.col("fp"), F.col("fn")))


@query(
    over(
        f"""turns AS (SELECT conv_id, turn, role, {SPACED.format('text')} AS w FROM conversations),
pairs AS (SELECT u.conv_id, u.turn, u.w AS a, t.w AS b FROM turns u JOIN turns t ON u.conv_id = t.conv_id AND t.turn = u.turn + 1 AND u.role = 'user' AND t.role = 'assistant'),
l AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE {LCS.format(a="a", b="b")} END AS n FROM pairs)""",
        "SELECT conv_id, turn, round(coalesce(2.0 * n / nullif(len(a) + len(b), 0), 0), 6) AS rouge_l FROM l",
    )
)
def rouge_l_spaced(spark, sf_dir):
    """ROUGE-L over words and the white space between them."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.words_and_spaces(F.col("text")).alias("w"))
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("w").alias("a"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("b"))
    return user.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.round(rouge.rouge_l(F.col("a"), F.col("b")), 6).alias("rouge_l"))


@query(
    over(
        EVIDENCE
        + """, r AS (SELECT doc_id, n_gold, count(*) FILTER (rd <= 3) AS k, count(*) FILTER (rd <= 3 AND is_gold = 1) AS found, count(*) FILTER ((rd <= 10 OR rb <= 10) AND is_gold = 1) AS reach FROM evidence GROUP BY doc_id, n_gold)""",
        """SELECT count(*) AS n, count(*) FILTER (reach > 0) AS reachable, round(avg(k), 6) AS mean_found, round(avg(n_gold), 6) AS mean_gold, round(CAST(sum(found) AS DOUBLE) / CAST(sum(k) AS DOUBLE), 6) AS precision,
round(CAST(sum(found) AS DOUBLE) / CAST(sum(reach) AS DOUBLE), 6) AS recall_of_reachable FROM r""",
    )
)
def micro_prf_reachable(spark, sf_dir):
    """Precision, recall of the gold that the pool holds at all, and mean set sizes."""
    gold = F.col("is_gold") == 1
    r = _evidence(spark, sf_dir).groupBy("doc_id", "n_gold").agg(
        F.count_if(F.col("rd") <= 3).alias("k"), F.count_if((F.col("rd") <= 3) & gold).alias("found"), F.count_if(((F.col("rd") <= 10) | (F.col("rb") <= 10)) & gold).alias("reach")
    )
    return r.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reach") > 0).alias("reachable"), F.round(F.avg("k"), 6).alias("mean_found"), F.round(F.avg("n_gold"), 6).alias("mean_gold"),
        F.round(F.sum("found") / F.sum("k"), 6).alias("precision"), F.round(F.sum("found") / F.sum("reach"), 6).alias("recall_of_reachable"),
    )


@query(
    over(
        EVIDENCE + ", p AS (SELECT a.doc_id, round(b.mrr - a.mrr, 9) AS d FROM metrics a JOIN metrics b ON a.doc_id = b.doc_id WHERE a.method = 'dense' AND b.method = 'bm25'), q AS (SELECT p.d, k.n FROM p JOIN asked k USING (doc_id))",
        """SELECT CASE WHEN n <= 5 THEN CAST(n AS VARCHAR) ELSE '6+' END AS bucket, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median,
count(*) FILTER (d > 1e-9) AS wins, count(*) FILTER (d < -1e-9) AS losses FROM q GROUP BY 1""",
    )
)
def bucket_summary(spark, sf_dir):
    """How two systems differ by the length of the document: mean, median, wins and losses."""
    rank = lambda r: F.coalesce(1.0 / F.min(F.when(F.col("is_gold") == 1, F.col(r))), F.lit(0.0))
    d = _evidence(spark, sf_dir).groupBy("doc_id", "n").agg(F.round(rank("rb") - rank("rd"), 9).alias("d"))
    return analysis.bucket_summary(d.withColumn("bucket", pools.bucket_of(F.col("n"))), "d", ["bucket"])


@query(
    over(
        ARRAYS + ", r AS (SELECT d.doc_id, d.lang, unnest([1 + d.doc_id % 9, 1 + d.doc_id % 4]) AS pos FROM documents d)",
        "SELECT lang, count(*) AS refs, count(*) FILTER (p.pos IS NULL) AS absent FROM r LEFT JOIN paras p ON r.doc_id = p.doc_id AND r.pos = p.pos GROUP BY lang",
    )
)
def gold_absent(spark, sf_dir):
    """References that name no valid paragraph of their document (here places made from the id), by language."""
    docs = read(spark, sf_dir, "documents")
    refs = docs.select("doc_id", "lang", F.explode(F.array(1 + F.col("doc_id") % 9, 1 + F.col("doc_id") % 4)).alias("pos"))
    valid = ev.paragraphs(docs).select("doc_id", "pos", F.lit(True).alias("_valid"))
    both = refs.join(valid, ["doc_id", "pos"], "left")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("_valid").isNull()).alias("absent"))


@query(
    over(
        EVIDENCE + FORM.replace("p.text, len(", "p.text, len(p.tokens) AS n_tokens, len("),
        "SELECT f.doc_id, f.pos FROM f JOIN evidence e ON f.doc_id = e.doc_id AND f.pos = e.pos WHERE e.n_gold = 1 AND f.restate >= 0.8 AND f.n_tokens BETWEEN 20 AND 35",
    )
)
def candidate_hard_constraints(spark, sf_dir):
    """Worked examples by the strict rules: one reference, at least 0.8 of the head restated, 20 to 35 words."""
    d = ev.scored(read(spark, sf_dir, "documents")).where("n_gold = 1")
    head, words = F.get("ts", F.lit(0)), lambda x: F.get("ts", (x["pos"] - 1).cast("int"))
    kept = F.filter("s", lambda x: x["len"].between(20, 35) & (text.restate_score(words(x), head) >= 0.8))
    return ev.stage(d, ["doc_id"], kept=kept).select("doc_id", F.explode("kept.pos").alias("pos"))


@query(
    over(
        EVIDENCE
        + f""", c AS (SELECT doc_id, n_gold, is_gold, rd = 1 OR (rd = 2 AND {HEX.format("'avg:' || doc_id", 1, 8)} / 4294967296.0 < 0.49) AS cited FROM evidence),
per AS (SELECT doc_id, n_gold, count(*) FILTER (cited) AS k, count(*) FILTER (cited AND is_gold = 1) AS found FROM c GROUP BY doc_id, n_gold)""",
        "SELECT count(*) AS n, round(avg(k), 6) AS mean_k, round(avg(found / CAST(k + n_gold - found AS DOUBLE)), 6) AS iou FROM per",
    )
)
def citation_average_k(spark, sf_dir):
    """The average-K model: the first rank always, the second so often that 1.49 are cited on average; hash-seeded."""
    cited = pools.average_k(_evidence(spark, sf_dir), 1.49)
    per = cited.groupBy("doc_id", "n_gold").agg(F.sum("cited").alias("k"), F.sum(F.col("cited") * F.col("is_gold")).alias("found"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean_k"), F.round(F.avg(F.col("found") / (F.col("k") + F.col("n_gold") - F.col("found"))), 6).alias("iou"))


@query("SELECT l.doc_id, l.quality AS gold, CAST(d.n_chars > 200 AS INT) AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def gold_join_prediction(spark, sf_dir):
    """Gold with a prediction each; a gold row without one fails the job."""
    predicted = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 200).cast("int").alias("predicted"))
    return analysis.with_predictions(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold")), predicted, "doc_id", "predicted")


@query(over(EVIDENCE, "SELECT CAST(rd AS BIGINT) AS rank, count(*) AS n, count(*) FILTER (is_gold = 1) AS gold, round(avg(len), 6) AS mean_len FROM evidence WHERE rd <= 5 GROUP BY rd"))
def rank_profile(spark, sf_dir):
    """What stands at each of the first five dense ranks."""
    e = _evidence(spark, sf_dir).where("rd <= 5")
    return e.groupBy(F.col("rd").alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_gold") == 1).alias("gold"), F.round(F.avg("len"), 6).alias("mean_len"))


@query(
    over(
        "c AS (SELECT conv_id, role, turn, len(regexp_extract_all(text, '[^ \\t\\n]+')) AS w FROM conversations), s AS (SELECT *, sum(w) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM c)",
        "SELECT conv_id, turn, CAST(w AS BIGINT) AS words, CAST(upto AS BIGINT) AS upto FROM s WHERE upto <= 200",
    )
)
def content_word_budget(spark, sf_dir):
    """Turns that fit into a budget of words counted from the conversation's begin."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit(r"[^ \t\n]+")).cast("long").alias("words"))
    return c.withColumn("upto", F.sum("words").over(Window.partitionBy("conv_id").orderBy("turn"))).where("upto <= 200").select("conv_id", "turn", "words", "upto")
