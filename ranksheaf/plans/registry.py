"""All queries on the engine's own operators, and the SQL that each agrees with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citations, rouge, sets, text
from ..operators import analysis, inference, pools, prompts, vectors
from ..operators import evidence as ev
from .oracle import ARRAYS, EVIDENCE, HEX, VECTORS, WORDS, over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evidence(read(spark, sf_dir, "documents"))


def _scored(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    return ev.scored(read(spark, sf_dir, "documents"), also=also)


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.paragraphs(read(spark, sf_dir, "documents"))


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question and system: recall@5, the first paragraph's similarity and IoU@1 in the places of the three metrics."""
    m = ev.methods(_evidence(spark, sf_dir))
    w = Window.partitionBy("method", "doc_id")
    gold, rank = F.col("is_gold") == 1, F.col("rank")
    rows = m.withColumn("in5", F.count_if(gold & (rank <= 5)).over(w)).where("rank = 1")
    n = F.col("n_gold").cast("double")
    return rows.select(F.col("method").alias("system"), "doc_id", (F.col("in5") / n).alias("rouge_l"), F.col("dense").alias("ss"), (F.col("is_gold") / (n + 1 - F.col("is_gold"))).alias("iou"))


# -- paragraphs and tokens


@query(over(ARRAYS, "SELECT doc_id, pos, para_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(tokens) AS BIGINT) AS n_tokens FROM paras"))
def para_explode(spark, sf_dir):
    return _paragraphs(spark, sf_dir).select("doc_id", "pos", "para_id", F.length("text").cast("long").alias("n_chars"), F.size("tokens").cast("long").alias("n_tokens"))


@query(
    over(
        ARRAYS,
        r"""SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, coalesce(a.n, 0) AS n_valid
FROM documents d LEFT JOIN arrays a ON d.doc_id = a.doc_id""",
    )
)
def para_valid_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, text.is_valid_paragraph)).cast("long").alias("n_valid"))


STATS = """CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.9), 6) AS p90,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST({c} AS DOUBLE), 0.99), 6) AS p99,
  CAST(min({c}) AS BIGINT) AS least, CAST(max({c}) AS BIGINT) AS most"""


@query(over(ARRAYS, f"SELECT d.lang, {STATS.format(c='len(tokens)')} FROM paras p JOIN documents d ON p.doc_id = d.doc_id GROUP BY d.lang"))
def token_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), text.is_valid_paragraph)
    rows = docs.select("lang", F.explode(F.transform(lines, lambda p: F.size(text.words(p)).cast("long"))).alias("tokens"))
    return analysis.percentiles(rows, "tokens", ["lang"])


# -- ranking


@query(over(EVIDENCE, "SELECT doc_id, pos, rb AS rank, round(bm25, 6) AS score, CAST(is_gold AS BIGINT) AS is_gold FROM evidence WHERE rb <= 5"))
def bm25_topk(spark, sf_dir):
    return _evidence(spark, sf_dir).where("rb <= 5").select("doc_id", "pos", F.col("rb").alias("rank"), F.round("bm25", 6).alias("score"), "is_gold")


@query(over(EVIDENCE, "SELECT doc_id, pos, rd AS rank, round(dense, 6) AS score, CAST(is_gold AS BIGINT) AS is_gold FROM evidence WHERE rd <= 5"))
def dense_topk(spark, sf_dir):
    return _evidence(spark, sf_dir).where("rd <= 5").select("doc_id", "pos", F.col("rd").alias("rank"), F.round("dense", 6).alias("score"), "is_gold")


@query(over(EVIDENCE, "SELECT doc_id, pos, rr AS rank, round(rrf, 6) AS score FROM ranked WHERE rr <= 10"))
def rrf_fusion(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("rrf", ev.rounded(ev.rrf_score("rb", "rd"))).withColumn("rank", ev.by_score("rrf"))
    return e.where("rank <= 10").select("doc_id", "pos", "rank", F.round("rrf", 6).alias("score"))


MIN_MAX = "coalesce(({c} - min({c}) OVER d) / nullif(max({c}) OVER d - min({c}) OVER d, 0), 0)"


@query(
    over(
        EVIDENCE
        + f""", w AS (SELECT doc_id, pos, round(0.5 * {MIN_MAX.format(c='dense')} + 0.5 * {MIN_MAX.format(c='bm25')}, 9) AS s FROM evidence WINDOW d AS (PARTITION BY doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, pos) AS rank FROM w)""",
        "SELECT doc_id, pos, rank, round(s, 6) AS score FROM r WHERE rank <= 10",
    )
)
def weighted_fusion(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("s", ev.rounded(ev.weighted_score("dense", "bm25", 0.5))).withColumn("rank", ev.by_score("s"))
    return e.where("rank <= 10").select("doc_id", "pos", "rank", F.round("s", 6).alias("score"))


@query(
    over(
        EVIDENCE,
        "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN rd <= 20 THEN rd ELSE 20 + rb END) AS pool_pos FROM evidence WHERE rd <= 20 OR rb <= 20",
    )
)
def union_pool(spark, sf_dir):
    return ev.union_pool(_evidence(spark, sf_dir), 20).select("doc_id", "pos", "pool_pos")


TOKENS_AS_BUCKETS = f"list_transform({{}}, lambda t: [{HEX.format('t', 1, 4)} % 64, {HEX.format('t', 5, 4)} % 64])"


@query(
    over(
        EVIDENCE
        + f""", sims AS (
  SELECT doc_id, pos, list_sum(list_transform({TOKENS_AS_BUCKETS.format('q')}, lambda a: coalesce(list_max(list_transform({TOKENS_AS_BUCKETS.format('toks')},
         lambda b: (CAST(a[1] = b[1] AS INT) + CAST(a[2] = b[2] AS INT)) / 2.0)), 0.0))) AS s FROM ptoks),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, pos) AS rank FROM sims)""",
        "SELECT doc_id, pos, rank, CAST(s AS DOUBLE) AS score FROM r WHERE rank <= 5",
    )
)
def colbert_maxsim(spark, sf_dir):
    e = ev.evidence(read(spark, sf_dir, "documents"), late=True)
    return e.where("rl <= 5").select("doc_id", "pos", F.col("late").alias("score"), F.col("rl").alias("rank"))


MEANS = "CAST(count(*) AS BIGINT) AS n_queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ev.METRICS)


@query(over(EVIDENCE, f"SELECT method, {MEANS} FROM metrics GROUP BY method"))
def flagship_retrieval_eval(spark, sf_dir):
    return ev.mean_metrics(ev.document_metrics(_scored(spark, sf_dir)), ["method"])


FLAGSHIP = flagship_retrieval_eval


@query(over(EVIDENCE, "SELECT method, doc_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in ev.METRICS) + " FROM metrics"))
def rank_metrics_hit_mrr_iou(spark, sf_dir):
    per = ev.document_metrics(_scored(spark, sf_dir))
    return per.select("method", "doc_id", *(F.round(m, 6).alias(m) for m in ev.METRICS))


# -- pools and cut-offs


@query(
    over(
        EVIDENCE
        + """, s AS (SELECT unnest([1, 2, 3, 5, 10, 20, 50]) AS pool_n),
per AS (SELECT pool_n, doc_id, n_gold, count(*) FILTER (least(rd, rb) <= pool_n) AS size, count(*) FILTER (least(rd, rb) <= pool_n AND is_gold = 1) AS found FROM evidence, s GROUP BY pool_n, doc_id, n_gold)""",
        """SELECT CAST(pool_n AS BIGINT) AS pool_n, round(avg(size), 6) AS mean_size, round(avg(CAST(found > 0 AS DOUBLE)), 6) AS recall,
round(CAST(sum(found) AS DOUBLE) / CAST(sum(n_gold) AS DOUBLE), 6) AS ref_recall, round(avg(found / CAST(size + n_gold - found AS DOUBLE)), 6) AS iou_full FROM per GROUP BY pool_n""",
    )
)
def pool_size_sweep(spark, sf_dir):
    return pools.size_sweep(_evidence(spark, sf_dir))


@query(
    over(
        EVIDENCE
        + """, x AS (
  SELECT 'dense' AS pool, doc_id, is_gold, rd <= 20 AS inside FROM evidence UNION ALL SELECT 'bm25', doc_id, is_gold, rb <= 20 FROM evidence
  UNION ALL SELECT 'union', doc_id, is_gold, rd <= 20 OR rb <= 20 FROM evidence UNION ALL SELECT 'intersection', doc_id, is_gold, rd <= 20 AND rb <= 20 FROM evidence)""",
        """SELECT pool, round(count(*) FILTER (inside) / CAST(count(DISTINCT doc_id) AS DOUBLE), 6) AS mean_size, CAST(count(*) FILTER (inside AND is_gold = 1) AS BIGINT) AS gold_found,
CAST(sum(is_gold) AS BIGINT) AS gold FROM x GROUP BY pool""",
    )
)
def pool_algebra(spark, sf_dir):
    return pools.algebra(_evidence(spark, sf_dir), 20)


@query(
    over(
        EVIDENCE,
        """SELECT CASE WHEN rd <= 5 AND rb <= 5 THEN 'both' WHEN rd <= 5 THEN 'dense only' WHEN rb <= 5 THEN 'bm25 only' ELSE 'neither' END AS found_by,
count(*) AS n FROM evidence WHERE is_gold = 1 GROUP BY 1""",
    )
)
def gold_contribution(spark, sf_dir):
    return pools.contribution(_evidence(spark, sf_dir), 5)


@query(
    over(
        EVIDENCE + ", per AS (SELECT doc_id, n_gold, count(*) FILTER (rd <= 5 AND is_gold = 1) AS found FROM evidence GROUP BY doc_id, n_gold)",
        """SELECT CASE WHEN n_gold <= 5 THEN CAST(n_gold AS VARCHAR) ELSE '6+' END AS bucket, count(*) AS n, round(CAST(sum(found) AS DOUBLE) / CAST(sum(n_gold) AS DOUBLE), 6) AS micro,
round(avg(found / CAST(n_gold AS DOUBLE)), 6) AS macro, round(avg(CAST(found > 0 AS DOUBLE)), 6) AS hit FROM per GROUP BY 1""",
    )
)
def gold_bucket_recall(spark, sf_dir):
    return pools.bucket_recall(_evidence(spark, sf_dir), 5)


ALPHAS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0]


@query(
    over(
        EVIDENCE
        + f""", a AS (SELECT CAST(unnest({ALPHAS}) AS DOUBLE) AS alpha),
mm AS (SELECT doc_id, pos, is_gold, n_gold, {MIN_MAX.format(c='dense')} AS d, {MIN_MAX.format(c='bm25')} AS b FROM evidence WINDOW d AS (PARTITION BY doc_id)),
s AS (SELECT alpha, doc_id, pos, is_gold, n_gold, round((1 - alpha) * d + alpha * b, 9) AS s FROM mm, a),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha, doc_id ORDER BY s DESC, pos) AS rank FROM s),
per AS (SELECT alpha, doc_id, max(CASE WHEN is_gold = 1 AND rank = 1 THEN 1.0 ELSE 0.0 END) AS hit1, coalesce(1.0 / min(CASE WHEN is_gold = 1 THEN rank END), 0) AS mrr FROM r GROUP BY alpha, doc_id)""",
        "SELECT alpha, count(*) AS n, round(avg(hit1), 6) AS hit1, round(avg(mrr), 6) AS mrr FROM per GROUP BY alpha",
    )
)
def fusion_alpha_sweep(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("d", ev.min_max("dense")).withColumn("b", ev.min_max("bm25"))
    s = pools.with_parameter(e.select("doc_id", "pos", "is_gold", "d", "b"), "alpha", ALPHAS)
    s = s.withColumn("s", ev.rounded((1 - F.col("alpha")) * F.col("d") + F.col("alpha") * F.col("b")))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("alpha", "doc_id").orderBy(F.desc("s"), "pos")))
    gold = F.col("is_gold") == 1
    per = r.groupBy("alpha", "doc_id").agg(F.max((gold & (F.col("rank") == 1)).cast("double")).alias("hit1"), F.coalesce(1.0 / F.min(F.when(gold, F.col("rank"))), F.lit(0.0)).alias("mrr"))
    return per.groupBy("alpha").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit1"), 6).alias("hit1"), F.round(F.avg("mrr"), 6).alias("mrr"))


def _adaptive_sql(values: list[float], keep: str) -> str:
    return over(
        EVIDENCE
        + f""", v AS (SELECT CAST(unnest({values}) AS DOUBLE) AS value),
t AS (SELECT *, max(dense) OVER (PARTITION BY doc_id) AS top FROM evidence),
per AS (
  SELECT value, doc_id, n_gold, count(*) FILTER (({keep}) OR rd = 1) AS k, count(*) FILTER ((({keep}) OR rd = 1) AND is_gold = 1) AS found
  FROM t, v WHERE rd <= 5 GROUP BY value, doc_id, n_gold)""",
        "SELECT value, round(avg(k), 6) AS mean_k, round(avg(found / CAST(k + n_gold - found AS DOUBLE)), 6) AS iou FROM per GROUP BY value",
    )


GAPS, THRESHOLDS, RATIOS = [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]


@query(_adaptive_sql(GAPS, "round(top - dense, 9) <= value"))
def adaptive_k_gap(spark, sf_dir):
    return pools.adaptive(_evidence(spark, sf_dir), "gap", GAPS)


@query(_adaptive_sql(THRESHOLDS, "dense > value"))
def adaptive_k_threshold(spark, sf_dir):
    return pools.adaptive(_evidence(spark, sf_dir), "threshold", THRESHOLDS)


@query(_adaptive_sql(RATIOS, "top > 0 AND round(dense / nullif(top, 0), 9) >= value"))
def adaptive_k_ratio(spark, sf_dir):
    return pools.adaptive(_evidence(spark, sf_dir), "ratio", RATIOS)


@query(_adaptive_sql(GAPS, "round(top - dense, 9) <= value").replace("FROM per GROUP BY value", "FROM per GROUP BY value ORDER BY iou DESC, value LIMIT 1"))
def best_gap(spark, sf_dir):
    return pools.best_value(pools.adaptive(_evidence(spark, sf_dir), "gap", GAPS))


@query(
    over(
        EVIDENCE + ", per AS (SELECT doc_id, n_gold, count(*) FILTER (rd <= n_gold AND is_gold = 1) AS found FROM evidence GROUP BY doc_id, n_gold)",
        "SELECT count(*) AS n, round(avg(found / CAST(2 * n_gold - found AS DOUBLE)), 6) AS iou FROM per",
    )
)
def oracle_k(spark, sf_dir):
    return pools.oracle_k(_evidence(spark, sf_dir))


@query(
    over(
        EVIDENCE
        + """, f AS (SELECT *, sum(is_gold) OVER (PARTITION BY doc_id ORDER BY rd) AS found FROM evidence WHERE rd <= 10),
b AS (SELECT *, max(found / CAST(rd + n_gold - found AS DOUBLE)) OVER (PARTITION BY doc_id ORDER BY rd) AS best FROM f)""",
        "SELECT rd AS k, count(*) AS n, round(avg(best), 6) AS best_iou FROM b GROUP BY rd",
    )
)
def best_iou_oracle(spark, sf_dir):
    return pools.best_iou(_evidence(spark, sf_dir), 10)


RATES = [0.8, 0.3, 0.2, 0.15, 0.1]


@query(
    over(
        EVIDENCE
        + f""", c AS (
  SELECT doc_id, n_gold, is_gold, {HEX.format("'cite:' || doc_id || ':' || pos", 1, 8)} / 4294967296.0
         < CASE WHEN rd = 1 THEN 1 WHEN rd <= 5 THEN {RATES}[rd] ELSE greatest(0.05, 0.1 * pow(0.8, rd - 5)) END AS cited FROM evidence),
per AS (SELECT doc_id, n_gold, count(*) FILTER (cited) AS k, count(*) FILTER (cited AND is_gold = 1) AS found FROM c GROUP BY doc_id, n_gold)""",
        "SELECT count(*) AS n, round(avg(k), 6) AS mean_k, round(avg(found / CAST(k + n_gold - found AS DOUBLE)), 6) AS iou FROM per",
    )
)
def citation_simulation(spark, sf_dir):
    c = pools.simulated_citations(_evidence(spark, sf_dir), RATES)
    per = c.groupBy("doc_id", "n_gold").agg(F.sum("cited").alias("k"), F.sum(F.col("cited") * F.col("is_gold")).alias("found"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean_k"), F.round(F.avg(F.col("found") / (F.col("k") + F.col("n_gold") - F.col("found"))), 6).alias("iou"))


# -- sets and paired evaluation


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per question: gold, the dense top 3 and the BM25 top 3 as arrays of ids."""
    e = _evidence(spark, sf_dir)
    pid = F.concat(F.lit("P"), "pos")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, pid)))
    return e.groupBy("doc_id").agg(pick(F.col("is_gold") == 1).alias("gold"), pick(F.col("rd") <= 3).alias("dense3"), pick(F.col("rb") <= 3).alias("bm253"))


SETS = EVIDENCE + """, picked AS (
  SELECT doc_id, coalesce(list('P' || pos) FILTER (is_gold = 1), []) AS gold, list('P' || pos) FILTER (rd <= 3) AS dense3, list('P' || pos) FILTER (rb <= 3) AS bm253 FROM evidence GROUP BY doc_id)"""
IOU = "len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE)"


@query(over(SETS, f"SELECT doc_id, round({IOU.format(a='gold', b='dense3')}, 6) AS iou_scored, round({IOU.format(a='gold', b='bm253')}, 6) AS jaccard_bm25, round({IOU.format(a='dense3', b='bm253')}, 6) AS iou_lab FROM picked"))
def set_iou_three_variants(spark, sf_dir):
    s = _sets(spark, sf_dir)
    g, d, b = F.col("gold"), F.col("dense3"), F.col("bm253")
    return s.select("doc_id", F.round(sets.iou_scored(g, d), 6).alias("iou_scored"), F.round(sets.jaccard(g, b), 6).alias("jaccard_bm25"), F.round(sets.iou_lab(d, b), 6).alias("iou_lab"))


@query(
    over(
        SETS
        + """, c AS (SELECT sum(len(list_intersect(gold, dense3))) AS tp, sum(len(dense3) - len(list_intersect(gold, dense3))) AS fp, sum(len(gold) - len(list_intersect(gold, dense3))) AS fn FROM picked)""",
        """SELECT 'dense3' AS system, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round(2.0 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    )
)
def micro_prf(spark, sf_dir):
    return analysis.micro_prf(_sets(spark, sf_dir).withColumn("system", F.lit("dense3")), "gold", "dense3", ["system"])


@query(
    over(
        EVIDENCE + ", p AS (SELECT a.doc_id, a.mrr AS a, b.mrr AS b FROM metrics a JOIN metrics b ON a.doc_id = b.doc_id WHERE a.method = 'dense' AND b.method = 'bm25')",
        """SELECT 'bm25 - dense' AS pair, count(*) FILTER (b - a > 1e-9) AS wins, count(*) FILTER (abs(b - a) <= 1e-9) AS ties, count(*) FILTER (b - a < -1e-9) AS losses,
round(avg(b - a), 6) AS mean_delta FROM p""",
    )
)
def win_tie_loss(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    rank = lambda r: F.coalesce(1.0 / F.min(F.when(F.col("is_gold") == 1, F.col(r))), F.lit(0.0))
    return analysis.outcomes(e.groupBy("doc_id").agg(rank("rd").alias("a"), rank("rb").alias("b")).withColumn("pair", F.lit("bm25 - dense")), "a", "b", ["pair"])


@query(over(SETS, "SELECT CAST(least(len(gold), 5) AS BIGINT) AS n_cited, count(*) AS n FROM picked GROUP BY 1"))
def cited_histogram(spark, sf_dir):
    return _sets(spark, sf_dir).groupBy(F.least(F.size("gold"), F.lit(5)).cast("long").alias("n_cited")).agg(F.count(F.lit(1)).alias("n"))


@query(
    over(
        SETS,
        "SELECT count(*) AS n, count(*) FILTER (len(list_intersect(gold, dense3)) > 0) AS any_covered, count(*) FILTER (len(list_intersect(gold, dense3)) = len(gold)) AS all_covered FROM picked",
    )
)
def coverage_any_all(spark, sf_dir):
    s = _sets(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.arrays_overlap("gold", "dense3")).alias("any_covered"), F.count_if(F.size(F.array_except("gold", "dense3")) == 0).alias("all_covered"))


LCS = """list_reduce({a}, lambda row, x: list_reduce(range(1, len({b}) + 1), lambda acc, j:
  list_append(acc, CASE WHEN {b}[j] = x THEN row[j] + 1 ELSE greatest(acc[j], row[j + 1]) END), [0::BIGINT]), list_resize([]::BIGINT[], len({b}) + 1, 0))[-1]"""


@query(
    over(
        f"""turns AS (SELECT conv_id, turn, role, {WORDS.format('text')} AS w FROM conversations),
pairs AS (SELECT u.conv_id, u.turn, u.w AS a, t.w AS b FROM turns u JOIN turns t ON u.conv_id = t.conv_id AND t.turn = u.turn + 1 AND u.role = 'user' AND t.role = 'assistant'),
l AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE {LCS.format(a="list_concat([NULL::VARCHAR], a)", b="b").replace("list_reduce(list_concat([NULL::VARCHAR], a), lambda row, x:", "list_reduce(a, lambda row, x:")} END AS n FROM pairs)""",
        "SELECT conv_id, turn, round(coalesce(2.0 * n / nullif(len(a) + len(b), 0), 0), 6) AS rouge_l FROM l",
    )
)
def rouge_l(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.words(F.col("text")).alias("w"))
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("w").alias("a"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("b"))
    return user.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.round(rouge.rouge_l(F.col("a"), F.col("b")), 6).alias("rouge_l"))


SUMMARY = """count(*) AS n, round(avg(rouge_l), 6) AS rouge_l, round(avg(ss), 6) AS ss, round(avg(iou), 6) AS iou,
round(0.45 * avg(ss) + 0.35 * avg(rouge_l) + 0.20 * avg(iou), 6) AS composite, round(0.35 * avg(rouge_l) + 0.45 * avg(ss), 6) AS answer_sub"""


@query(over(EVIDENCE, f"SELECT system, {SUMMARY} FROM detail GROUP BY system"))
def composite_score(spark, sf_dir):
    return analysis.summary(_detail(spark, sf_dir), ["system"])


def _held_out_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of low labelled quality: what a leak-free score leaves out."""
    return read(spark, sf_dir, "labels").where("quality = 0").select("doc_id")


HELD = "WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"


@query(over(EVIDENCE, f"SELECT system, {SUMMARY} FROM detail {HELD} GROUP BY system"))
def heldout_score(spark, sf_dir):
    return analysis.summary(analysis.held_out(_detail(spark, sf_dir), _held_out_names(spark, sf_dir), "doc_id"), ["system"])


@query(
    over(
        EVIDENCE + f", s AS (SELECT system, {SUMMARY} FROM detail {HELD} GROUP BY system), b AS (SELECT * FROM s WHERE system = 'dense')",
        "SELECT s.system, s.n, s.composite, round(s.rouge_l - b.rouge_l, 6) AS delta_rouge_l, round(s.ss - b.ss, 6) AS delta_ss, round(s.iou - b.iou, 6) AS delta_iou, round(s.composite - b.composite, 6) AS delta_composite FROM s, b",
    )
)
def heldout_baseline_delta(spark, sf_dir):
    s = analysis.summary(analysis.held_out(_detail(spark, sf_dir), _held_out_names(spark, sf_dir), "doc_id"), ["system"])
    return analysis.against(s, s.where("system = 'dense'"), ["rouge_l", "ss", "iou", "composite"]).select("system", "n", "composite", "delta_rouge_l", "delta_ss", "delta_iou", "delta_composite")


# -- parsing of answers


TAGGED = """answers AS (
  SELECT conv_id, turn, text, 1 + (turn * 7 + conv_id) % 9 AS i, 1 + conv_id % 4 AS j,
         CASE WHEN (conv_id + turn) % 5 = 0 THEN text ELSE text || ' [อ้างอิง: ' || CAST(1 + (turn * 7 + conv_id) % 9 AS VARCHAR) || ', ' || CAST(1 + conv_id % 4 AS VARCHAR) || '] [อ้างอิง: 2,2]' END AS raw
  FROM conversations WHERE role = 'assistant')"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with citation tags put behind four in five of them."""
    a = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    i, j = (1 + (F.col("turn") * 7 + F.col("conv_id")) % 9).cast("string"), (1 + F.col("conv_id") % 4).cast("string")
    tagged = F.concat("text", F.lit(" [อ้างอิง: "), i, F.lit(", "), j, F.lit("] [อ้างอิง: 2,2]"))
    return a.select("conv_id", "turn", "text", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.col("text")).otherwise(tagged).alias("raw"))


TAG_RE = r"\[อ้างอิง[:\s]+([0-9,\s]+)\]"
IN_RANGE = "list_transform(list_filter(list_transform(regexp_extract_all({}, '[0-9]+'), lambda n: CAST(n AS INT)), lambda n: n >= 1 AND n <= 6), lambda n: n - 1)"


@query(
    over(
        TAGGED + f""", tags AS (SELECT conv_id, turn, {IN_RANGE.format(f"array_to_string(regexp_extract_all(raw, '{TAG_RE}', 1), ',')")} AS idx FROM answers)""",
        "SELECT conv_id, turn, array_to_string(list_sort(CASE WHEN len(idx) = 0 THEN [0] ELSE list_distinct(idx) END), ',') AS cited, CAST(CASE WHEN len(idx) = 0 THEN 0 ELSE idx[1] END AS BIGINT) AS first_cited FROM tags",
    )
)
def citation_parse_all(spark, sf_dir):
    idx = citations.cited(F.col("raw"), F.lit(6))
    joined = F.array_join(F.transform(F.array_sort(idx), lambda i: i.cast("string")), ",")
    return _answers(spark, sf_dir).select("conv_id", "turn", joined.alias("cited"), idx[0].cast("long").alias("first_cited"))


@query(
    over(
        TAGGED + f""", tags AS (SELECT conv_id, turn, {IN_RANGE.format(f"regexp_extract(raw, '{TAG_RE}', 1)")} AS idx FROM answers)""",
        "SELECT conv_id, turn, array_to_string(CASE WHEN len(idx) = 0 THEN [0] ELSE idx END, ',') AS cited FROM tags",
    )
)
def citation_parse_first(spark, sf_dir):
    idx = citations.cited_first(F.col("raw"), F.lit(6))
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(idx, lambda i: i.cast("string")), ",").alias("cited"))


STRIPPED = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(
    over(
        TAGGED,
        rf"""SELECT conv_id, turn, {STRIPPED.format(r"regexp_replace(raw, '\s*\[อ้างอิง[^\]]*\]', '', 'g')")} AS answer,
{STRIPPED.format(r"CASE WHEN contains(raw, '[อ้างอิง') THEN regexp_extract(raw, '(?s)^(.*)\[อ้างอิง', 1) ELSE raw END")} AS before_last, regexp_matches(raw, '{TAG_RE}') AS explicit FROM answers""",
    )
)
def citation_strip(spark, sf_dir):
    raw = F.col("raw")
    return _answers(spark, sf_dir).select("conv_id", "turn", citations.without_tags(raw).alias("answer"), citations.before_last_tag(raw).alias("before_last"), citations.has_citation(raw).alias("explicit"))


@query(
    over(
        "t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN '<think>' || text || '</think> ' || text ELSE text || '</think>' || role END AS raw FROM conversations)",
        rf"""SELECT conv_id, turn, {STRIPPED.format(r"regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), '(?s)^.*</think>', '')")} AS answer FROM t""",
    )
)
def think_strip(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<think>"), "text", F.lit("</think> "), "text")).otherwise(F.concat("text", F.lit("</think>"), "role"))
    return c.select("conv_id", "turn", citations.without_thoughts(raw).alias("answer"))


@query(
    over(
        r"t AS (SELECT conv_id, turn, 'คำตอบ: ' || regexp_extract(text, '^[^\n]*') || chr(10) || CASE WHEN turn % 2 = 0 THEN 'ย่อหน้าที่ใช้： ' ELSE '' END || CAST(1 + conv_id % 5 AS VARCHAR) || ', ๒' AS raw FROM conversations), "
        r"u AS (SELECT conv_id, turn, regexp_extract(raw, 'คำตอบ\s*[:：]\s*([^\n]*)', 1) AS a, translate(regexp_extract(raw, 'ย่อหน้าที่ใช้\s*[:：]\s*([^\n]*)', 1), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS s FROM t)",
        rf"SELECT conv_id, turn, {STRIPPED.format('a')} AS answer, array_to_string(list_sort(list_distinct({IN_RANGE.format('s')})), ',') AS used FROM u",
    )
)
def two_line_parse(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("คำตอบ: "), F.regexp_extract("text", r"^[^\n]*", 0), F.lit("\n"), F.when(F.col("turn") % 2 == 0, F.lit("ย่อหน้าที่ใช้： ")).otherwise(F.lit("")), (1 + F.col("conv_id") % 5).cast("string"), F.lit(", ๒"))
    answer, used = citations.two_lines(raw, F.lit(6))
    return c.select("conv_id", "turn", answer.alias("answer"), F.array_join(F.transform(F.array_sort(used), lambda i: i.cast("string")), ",").alias("used"))
