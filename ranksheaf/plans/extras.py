"""Further queries: strategy tables, score shapes, policies, reachability, changes between systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence as ev
from ..operators import pools
from .oracle import ARRAYS, EVIDENCE, over
from .registry import MIN_MAX, _evidence, _scored, query, read
from .studies import FORM, _form


def _all_ranks(e: DataFrame) -> DataFrame:
    e = e.withColumn("rrf", ev.rounded(ev.rrf_score("rb", "rd"))).withColumn("rr", ev.by_score("rrf"))
    for a in (0.3, 0.5, 0.7):
        name = f"w{round(100 * a)}"
        e = e.withColumn("s", ev.rounded(ev.weighted_score("dense", "bm25", a))).withColumn(name, ev.by_score("s"))
    return e


STRATEGIES = EVIDENCE + f""", mm AS (SELECT *, {MIN_MAX.format(c='dense')} AS d, {MIN_MAX.format(c='bm25')} AS b FROM ranked WINDOW d AS (PARTITION BY doc_id)),
ws AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(0.7 * d + 0.3 * b, 9) DESC, pos) AS w30, row_number() OVER (PARTITION BY doc_id ORDER BY round(0.5 * d + 0.5 * b, 9) DESC, pos) AS w50,
         row_number() OVER (PARTITION BY doc_id ORDER BY round(0.3 * d + 0.7 * b, 9) DESC, pos) AS w70 FROM mm),
ns AS (SELECT unnest([5, 10, 20]) AS k),
ins AS (
  SELECT 'dense_' || k AS strategy, doc_id, is_gold, n_gold, rd <= k AS inside FROM ws, ns UNION ALL SELECT 'bm25_' || k, doc_id, is_gold, n_gold, rb <= k FROM ws, ns
  UNION ALL SELECT 'union_' || k, doc_id, is_gold, n_gold, rd <= k OR rb <= k FROM ws, ns UNION ALL SELECT 'intersection_' || k, doc_id, is_gold, n_gold, rd <= k AND rb <= k FROM ws, ns
  UNION ALL SELECT 'rrf_' || k, doc_id, is_gold, n_gold, rr <= k FROM ws, ns UNION ALL SELECT 'weighted30_' || k, doc_id, is_gold, n_gold, w30 <= k FROM ws, ns
  UNION ALL SELECT 'weighted50_' || k, doc_id, is_gold, n_gold, w50 <= k FROM ws, ns UNION ALL SELECT 'weighted70_' || k, doc_id, is_gold, n_gold, w70 <= k FROM ws, ns
  UNION ALL SELECT 'all', doc_id, is_gold, n_gold, true FROM ws),
per AS (SELECT strategy, doc_id, n_gold, count(*) FILTER (inside) AS size, count(*) FILTER (inside AND is_gold = 1) AS found FROM ins GROUP BY ALL)"""


@query(
    over(
        STRATEGIES,
        """SELECT strategy, round(avg(size), 6) AS size, round(avg(CAST(found > 0 AS DOUBLE)), 6) AS recall, round(CAST(sum(found) AS DOUBLE) / CAST(sum(n_gold) AS DOUBLE), 6) AS ref_recall,
round(avg(found / CAST(size + n_gold - found AS DOUBLE)), 6) AS iou_full, min(size) AS least, max(size) AS most FROM per GROUP BY strategy""",
    )
)
def pool_strategies(spark, sf_dir):
    return pools.strategy_table(_all_ranks(_evidence(spark, sf_dir)), pools.strategies())


SHAPE = EVIDENCE + """, sh AS (SELECT doc_id, rd, n_gold, is_gold, dense AS s, max(dense) OVER (PARTITION BY doc_id) AS top, lead(dense) OVER (PARTITION BY doc_id ORDER BY rd) AS nxt FROM evidence)"""


@query(
    over(
        SHAPE,
        """SELECT doc_id, round(max(CASE WHEN rd = 1 THEN s - nxt END), 6) AS gap, round(max(CASE WHEN rd = 1 THEN coalesce(nxt / greatest(s, 1e-9), 0) END), 6) AS ratio, count(*) FILTER (s >= 0.5 * top) AS over_half,
count(*) FILTER (s >= 0.9 * top) AS near_top, round(avg(CASE WHEN rd <= 5 THEN s END), 6) AS mean5, round(stddev_pop(CASE WHEN rd <= 5 THEN s END), 6) AS std5 FROM sh GROUP BY doc_id""",
    )
)
def score_shape(spark, sf_dir):
    return pools.shape(ev.dense_scores(read(spark, sf_dir, "documents")))


@query(
    over(
        SHAPE
        + """, k AS (SELECT doc_id, count(*) FILTER (s >= 0.9 * top) AS near FROM sh GROUP BY doc_id),
p AS (SELECT 'one' AS policy, sh.*, 1 AS k FROM sh UNION ALL SELECT 'two', sh.*, 2 FROM sh UNION ALL SELECT 'oracle', sh.*, n_gold FROM sh UNION ALL SELECT 'near_top', sh.*, near FROM sh JOIN k USING (doc_id)),
per AS (SELECT policy, doc_id, n_gold, count(*) AS size, sum(is_gold) AS found FROM p WHERE rd <= k GROUP BY ALL)""",
        "SELECT policy, count(*) AS n, round(avg(found / CAST(size + n_gold - found AS DOUBLE)), 6) AS iou FROM per GROUP BY policy",
    )
)
def policy_table(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    e = e.withColumn("top", F.max("dense").over(Window.partitionBy("doc_id"))).withColumn("near", F.count_if(F.col("dense") >= 0.9 * F.col("top")).over(Window.partitionBy("doc_id")))
    return pools.policy_iou(e, {"one": F.lit(1), "two": F.lit(2), "oracle": F.col("n_gold"), "near_top": F.col("near")})


@query(over(EVIDENCE, "SELECT doc_id, string_agg('P' || pos, ',' ORDER BY rd) AS order_by_score FROM evidence GROUP BY doc_id"))
def full_document_reranked(spark, sf_dir):
    """The whole document in order of score, nothing left out."""
    order = F.sort_array(F.transform("s", lambda x: F.struct(x["rd"].alias("rd"), x["pos"].alias("pos"))))
    return _scored(spark, sf_dir).select("doc_id", F.array_join(F.transform(order, lambda x: F.concat(F.lit("P"), x["pos"].cast("string"))), ",").alias("order_by_score"))


@query(
    over(
        EVIDENCE + ", g AS (SELECT e.*, d.lang FROM evidence e JOIN documents d USING (doc_id) WHERE is_gold = 1)",
        "SELECT lang, count(*) AS gold, count(*) FILTER (rd <= 20 OR rb <= 20) AS reachable, count(*) FILTER (dense = 0 AND bm25 = 0) AS unscored FROM g GROUP BY lang",
    )
)
def gold_reachability(spark, sf_dir):
    """How much gold a pool can hold at all, by language."""
    g = _scored(spark, sf_dir, "lang").select("lang", F.inline(F.filter("s", lambda x: x["is_gold"] == 1)))
    return g.groupBy("lang").agg(F.count(F.lit(1)).alias("gold"), F.count_if((F.col("rd") <= 20) | (F.col("rb") <= 20)).alias("reachable"), F.count_if((F.col("dense") == 0) & (F.col("bm25") == 0)).alias("unscored"))


DELTA = EVIDENCE + """, p AS (SELECT a.doc_id, round(b.mrr - a.mrr, 9) AS delta FROM metrics a JOIN metrics b ON a.doc_id = b.doc_id WHERE a.method = 'dense' AND b.method = 'bm25'),
o AS (SELECT *, row_number() OVER (ORDER BY delta, doc_id) AS lo, row_number() OVER (ORDER BY delta DESC, doc_id) AS hi FROM p)"""


@query(over(DELTA, "SELECT doc_id, round(delta, 6) AS delta, 'loss' AS side FROM o WHERE lo <= 15 UNION ALL SELECT doc_id, round(delta, 6), 'win' FROM o WHERE hi <= 10"))
def largest_changes(spark, sf_dir):
    """The 15 largest losses and 10 largest wins of BM25 against dense: a top-k report."""
    rank = lambda r: F.coalesce(1.0 / F.min(F.when(F.col("is_gold") == 1, F.col(r))), F.lit(0.0))
    p = _evidence(spark, sf_dir).groupBy("doc_id").agg(F.round(rank("rb") - rank("rd"), 9).alias("delta"))
    side = lambda order, n, name: p.orderBy(order, "doc_id").limit(n).select("doc_id", F.round("delta", 6).alias("delta"), F.lit(name).alias("side"))
    return side(F.asc("delta"), 15, "loss").unionByName(side(F.desc("delta"), 10, "win"))


@query(
    over(
        EVIDENCE
        + """, q AS (SELECT doc_id, max(CASE WHEN rd = 1 THEN is_gold END) AS was, max(CASE WHEN rb = 1 THEN is_gold END) AS now FROM evidence GROUP BY doc_id),
c AS (SELECT count(*) AS n, count(*) FILTER (was = 0) AS fails, count(*) FILTER (was = 1) AS hits, avg(CASE WHEN was = 0 THEN CAST(now AS DOUBLE) END) AS recover, avg(CASE WHEN was = 1 THEN 1.0 - now END) AS break FROM q)""",
        "SELECT n, fails, hits, round(recover, 6) AS recover, round(break, 6) AS break, round((coalesce(recover, 0) * fails - coalesce(break, 0) * hits) / n, 6) AS delta_hit1 FROM c",
    )
)
def rerank_extrapolation(spark, sf_dir):
    """What a second opinion changes in hit@1: share recovered of the failures less share broken of the hits."""
    e = _evidence(spark, sf_dir)
    q = e.groupBy("doc_id").agg(F.max(F.when(F.col("rd") == 1, F.col("is_gold"))).alias("was"), F.max(F.when(F.col("rb") == 1, F.col("is_gold"))).alias("now"))
    was, now = F.col("was") == 1, F.col("now").cast("double")
    c = q.agg(F.count(F.lit(1)).alias("n"), F.count_if(~was).alias("fails"), F.count_if(was).alias("hits"), F.avg(F.when(~was, now)).alias("r"), F.avg(F.when(was, 1.0 - now)).alias("b"))
    delta = (F.coalesce("r", F.lit(0.0)) * F.col("fails") - F.coalesce("b", F.lit(0.0)) * F.col("hits")) / F.col("n")
    return c.select("n", "fails", "hits", F.round("r", 6).alias("recover"), F.round("b", 6).alias("break"), F.round(delta, 6).alias("delta_hit1"))


@query(over(ARRAYS + FORM, "SELECT doc_id, pos FROM f WHERE pos > 1 AND restate >= 0.2 AND length(text) BETWEEN 20 AND 350"))
def candidate_constraints(spark, sf_dir):
    """Paragraphs that could serve as worked examples: they restate the head and are neither short nor long."""
    return _form(spark, sf_dir).where((F.col("pos") > 1) & (F.col("restate") >= 0.2) & F.length("text").between(20, 350)).select("doc_id", "pos")


@query("SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def gold_and_cache_filter(spark, sf_dir):
    """Keys that one table has and another's excluded ones are not among: a semi and an anti join."""
    docs, marks = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    kept = docs.join(marks.select("doc_id"), "doc_id", "left_semi").join(marks.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return kept.select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(
    over(
        ARRAYS,
        "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN q IN ('when', 'where', 'who', 'count') THEN 'factoid' WHEN q IN ('why', 'how') THEN 'explanation' ELSE 'other' END AS kind FROM (SELECT "
        + "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in text.QUESTION_CLASSES) + " ELSE 'other' END AS q FROM paras)) GROUP BY kind",
    )
)
def factoid_kinds(spark, sf_dir):
    p = ev.paragraphs(read(spark, sf_dir, "documents"))
    return p.groupBy(text.factoid_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
