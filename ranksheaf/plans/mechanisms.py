"""Queries on mechanisms of their own: best pairs, cross-validated regression and its policies, rescored caps, expected IoU."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations, rouge, segment, text
from ..operators import analysis, inference, late, logistic, pairs, pools, prompts
from ..operators import evidence as ev
from ..sources import corpus, scores, scratch, sinks
from ..sources.scratch import stored
from .oracle import ARRAYS, EVIDENCE, HEX, STRIP, WORDS, over
from .registry import LCS, RATES, TOKENS_AS_BUCKETS, _detail, _evidence, _scored, query, read
from .studies import CLASSES_SQL, FORM, LABELLED, _form, _labelled

# -- best pairs

CANDIDATES = ARRAYS + FORM + f", c AS (SELECT doc_id, pos, {CLASSES_SQL} AS cls, round(0.5 * restate + 0.25 * length, 9) AS score, restate, text FROM f)"


def _candidates(spark, sf_dir) -> DataFrame:
    """Paragraphs with the class of their question words and a score of form."""
    return _form(spark, sf_dir).select("doc_id", "pos", text.question_class(F.col("text")).alias("cls"), F.round(0.5 * F.col("restate") + 0.25 * F.col("length"), 9).alias("score"), "restate", "text")


@query(
    over(
        CANDIDATES + ", t AS (SELECT * FROM c WHERE pos > 1 AND restate >= 0.2 AND length(text) BETWEEN 20 AND 350)",
        """SELECT *, row_number() OVER (ORDER BY pair_score DESC, doc_a, pos_a, doc_b, pos_b) AS rank FROM (
SELECT a.doc_id AS doc_a, a.pos AS pos_a, a.cls AS cls_a, b.doc_id AS doc_b, b.pos AS pos_b, b.cls AS cls_b, a.score + b.score AS pair_score
FROM t a JOIN t b ON a.doc_id < b.doc_id AND a.cls <> b.cls ORDER BY pair_score DESC, doc_a, pos_a, doc_b, pos_b LIMIT 5)""",
    )
)
def global_diverse_pairs(spark, sf_dir):
    """The five best pairs of worked examples over all documents: other document, other class."""
    c = _candidates(spark, sf_dir).where((F.col("pos") > 1) & (F.col("restate") >= 0.2) & F.length("text").between(20, 350))
    return pairs.top_pairs(c, 5)


@query(
    over(
        CANDIDATES,
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pair_score DESC, pos_a, pos_b) AS rank FROM (
SELECT a.doc_id, a.pos AS pos_a, a.cls AS cls_a, b.pos AS pos_b, b.cls AS cls_b, a.score + b.score AS pair_score FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.cls <> b.cls)) WHERE rank <= 5""",
    )
)
def document_diverse_pairs(spark, sf_dir):
    """Each document's five best pairs of paragraphs of different classes."""
    return pairs.top_pairs_within(_candidates(spark, sf_dir), 5).select(F.col("doc_a").alias("doc_id"), "pos_a", "cls_a", "pos_b", "cls_b", "pair_score", "rank")


# -- logistic regression

FOLDS = 3


def newton_sql(steps: int = 14) -> str:
    """The regression on x1 and x2 of a relation ``given`` (id, y, fold, x1, x2) as a chain of Newton steps, to ``chances`` (id, y, fold, chance)."""
    scaled = f"""folds AS (SELECT unnest(range({FOLDS})) AS k),
scale AS MATERIALIZED (SELECT k, avg(x1) AS m1, stddev_pop(x1) + 1e-9 AS s1, avg(x2) AS m2, stddev_pop(x2) + 1e-9 AS s2 FROM folds JOIN given ON fold <> k GROUP BY k),
z AS MATERIALIZED (SELECT k, y, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b FROM scale JOIN given ON fold <> k),
w0 AS MATERIALIZED (SELECT k, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0.0::DOUBLE AS t FROM folds)"""
    for i in range(steps):
        scaled += f""",
p{i} AS (SELECT z.*, u, v, t, 1 / (1 + exp(-(u * a + v * b + t))) AS p FROM z JOIN w{i} USING (k)),
s{i} AS MATERIALIZED (
  SELECT k, u, v, t, avg((p - y) * a) + 0.01 * u AS g1, avg((p - y) * b) + 0.01 * v AS g2, avg(p - y) AS g3, avg(p * (1 - p) * a * a) + 0.01 AS h11, avg(p * (1 - p) * a * b) AS h12,
         avg(p * (1 - p) * a) AS h13, avg(p * (1 - p) * b * b) + 0.01 AS h22, avg(p * (1 - p) * b) AS h23, avg(p * (1 - p)) AS h33 FROM p{i} GROUP BY k, u, v, t),
d{i} AS (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM s{i}),
w{i + 1} AS MATERIALIZED (
  SELECT k, u - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det AS u,
         v - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det AS v,
         t - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det AS t FROM d{i})"""
    return scaled + f""",
chances AS MATERIALIZED (
  SELECT id, y, fold, 1 / (1 + exp(-(u * (x1 - m1) / (s1 + 1e-9) + v * (x2 - m2) / (s2 + 1e-9) + t))) AS chance FROM given JOIN scale ON fold = k JOIN w{steps} USING (k))"""


QUALITY = LABELLED.replace("d.lang,", "d.n_chars,") + f", given AS (SELECT doc_id AS id, y, {HEX.format("'fold:' || doc_id", 1, 8)} % {FOLDS} AS fold, s AS x1, ln(1 + n_chars) AS x2 FROM x), " + newton_sql()


def _chances(spark, sf_dir) -> DataFrame:
    """doc_id, y, fold and the out-of-fold chance of low quality from the share of symbols and the length."""
    rows = _labelled(spark, sf_dir).select("doc_id", F.col("y").alias("label"), inference.folds(F.col("doc_id"), FOLDS).cast("int").alias("fold"), F.array("s", F.log1p("n_chars")).alias("features"))
    return logistic.out_of_fold(stored(rows), FOLDS).select("doc_id", F.col("label").alias("y"), F.col("fold").cast("long").alias("fold"), "chance")


@query(over(QUALITY, "SELECT id AS doc_id, y, fold, round(chance, 6) AS chance FROM chances"))
def logreg_cv(spark, sf_dir):
    """Out-of-fold chances of a ridge-regularised logistic regression on scaled features, three folds by hash."""
    return _chances(spark, sf_dir).withColumn("chance", F.round("chance", 6))


@query(
    over(
        QUALITY
        + """, r AS (SELECT y, round(chance, 9) AS c FROM chances), k AS (SELECT y, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rk FROM r),
a AS (SELECT sum(y) AS p, count(*) - sum(y) AS n, sum(CASE WHEN y = 1 THEN rk END) AS ranks FROM k)""",
        "SELECT CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives, round(greatest(u, 1 - u), 6) AS auc FROM (SELECT *, coalesce((ranks - p * (p + 1) / 2.0) / nullif(CAST(p * n AS DOUBLE), 0), 0.5) AS u FROM a)",
    )
)
def logreg_auc(spark, sf_dir):
    """How well the out-of-fold chances order the labels."""
    return analysis.rank_sum_auc(_chances(spark, sf_dir).withColumn("chance", F.round("chance", 9)), "chance", "y", [])


GOLD_SHAPE = f"""q AS (
  SELECT doc_id, n_gold, max(CASE WHEN rd = 1 THEN dense END) - coalesce(max(CASE WHEN rd = 2 THEN dense END), 0) AS gap, count(*) FILTER (dense >= 0.9 * top) AS near,
         count(*) FILTER (CASE WHEN rd = 1 THEN true WHEN rd <= 5 THEN {{u}} < {RATES}[rd] ELSE {{u}} < greatest(0.05, 0.1 * pow(0.8, rd - 5)) END) AS cited
  FROM (SELECT *, max(dense) OVER (PARTITION BY doc_id) AS top FROM evidence) GROUP BY doc_id, n_gold)""".format(u=HEX.format("'cite:' || doc_id || ':' || pos", 1, 8) + " / 4294967296.0")


@query(
    over(
        EVIDENCE
        + f", {GOLD_SHAPE}, given AS (SELECT doc_id AS id, CAST(n_gold > 1 AS INT) AS y, {HEX.format("'fold:' || doc_id", 1, 8)} % {FOLDS} AS fold, gap AS x1, CAST(near AS DOUBLE) AS x2 FROM q), "
        + newton_sql()
        + """, k AS (SELECT q.*, round(c.chance, 6) AS chance FROM q JOIN chances c ON q.doc_id = c.id),
rules AS (
  SELECT doc_id, 'one' AS policy, 1 AS k FROM k UNION ALL SELECT doc_id, 'two', 2 FROM k UNION ALL SELECT doc_id, 'by_citation', CASE WHEN cited > 1 THEN 2 ELSE 1 END FROM k
  UNION ALL SELECT doc_id, 'by_logreg_0.5', CASE WHEN chance > 0.5 THEN 2 ELSE 1 END FROM k UNION ALL SELECT doc_id, 'by_logreg_0.3', CASE WHEN chance > 0.3 THEN 2 ELSE 1 END FROM k
  UNION ALL SELECT doc_id, 'oracle', CASE WHEN n_gold > 1 THEN 2 ELSE 1 END FROM k),
per AS (SELECT policy, e.doc_id, n_gold, count(*) AS size, sum(is_gold) AS found FROM rules r JOIN evidence e ON r.doc_id = e.doc_id AND e.rd <= r.k GROUP BY ALL)""",
        "SELECT policy, count(*) AS n, round(avg(found / CAST(size + n_gold - found AS DOUBLE)), 6) AS iou FROM per GROUP BY policy",
    )
)
def logreg_policies(spark, sf_dir):
    """Mean IoU when the number kept, one or two, is fixed, follows the citations, the regression on more than one gold paragraph, or the truth."""
    d = F.sort_array(F.col("s.dense"), asc=False)
    gold = lambda k: ev.total(F.filter("s", lambda x: x["rd"] <= k), lambda x: x["is_gold"], "long")
    near = F.size(F.filter("s.dense", lambda x: x >= 0.9 * F.get("d", F.lit(0)))).cast("double")
    q = ev.stage(_scored(spark, sf_dir), ["doc_id", "n", "n_gold", "s"], d=d)
    cited = ev.total(F.col("s"), lambda x: pools.is_cited(x["pos"], x["rd"], RATES), "long")
    made = {"gap": F.get("d", F.lit(0)) - F.coalesce(F.get("d", F.lit(1)), F.lit(0.0)), "near": near, "n_cited": cited, "found1": gold(1), "found2": gold(2)}
    q = ev.stage(q, ["doc_id", "n", "n_gold"], **made)
    rows = q.select("*", (F.col("n_gold") > 1).cast("int").alias("label"), inference.folds(F.col("doc_id"), FOLDS).cast("int").alias("fold"), F.array("gap", "near").alias("features"))
    rows = logistic.out_of_fold(stored(rows), FOLDS).withColumn("chance", F.round("chance", 6))
    two = lambda c: F.when(c, 2).otherwise(1)
    rules = {"one": F.lit(1), "two": F.lit(2), "by_citation": two(F.col("n_cited") > 1), "by_logreg_0.5": two(F.col("chance") > 0.5), "by_logreg_0.3": two(F.col("chance") > 0.3), "oracle": two(F.col("n_gold") > 1)}
    each = F.inline(F.array(*(F.struct(F.lit(name).alias("policy"), k.alias("k")) for name, k in rules.items())))
    per = rows.select("n", "n_gold", "found1", "found2", each)
    size, found = F.least("n", "k"), F.when(F.col("k") == 1, F.col("found1")).otherwise(F.col("found2"))
    return per.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(found / (size + F.col("n_gold") - found)), 6).alias("iou"))


# -- answers cut and scored again

WORD_CAPS, CHAR_CAPS = [8, 12, 16, 20, 25, 30, 40, 50, 75, 100], [40, 60, 80, 120, 160, 200, 300, 400]


@query(
    over(
        f"""turns AS (SELECT conv_id, turn, role, text, {WORDS.format('text')} AS w FROM conversations),
pairs AS (SELECT u.conv_id, u.turn, u.w AS a, t.w AS f, t.text AS raw FROM turns u JOIN turns t ON u.conv_id = t.conv_id AND t.turn = u.turn + 1 AND u.role = 'user' AND t.role = 'assistant'),
caps AS (SELECT 'w' AS unit, unnest({WORD_CAPS}) AS cap UNION ALL SELECT 'c', unnest({CHAR_CAPS}) UNION ALL SELECT 'none', 0),
cut AS (SELECT unit, cap, a, CASE unit WHEN 'w' THEN f[1:cap] WHEN 'c' THEN {WORDS.format('substring(raw, 1, cap)')} ELSE f END AS b FROM pairs, caps),
l AS (SELECT unit, cap, len(b) AS size, coalesce(2.0 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE {LCS.format(a='a', b='b')} END / nullif(len(a) + len(b), 0), 0) AS rl FROM cut),
m AS (SELECT unit, cap, count(*) AS n, round(avg(size), 6) AS mean_size, round(avg(rl), 6) AS rouge_l FROM l GROUP BY unit, cap)""",
        "SELECT unit, CAST(cap AS BIGINT) AS cap, n, mean_size, rouge_l, round(rouge_l - (SELECT rouge_l FROM m WHERE unit = 'none'), 6) AS delta_rouge_l FROM m",
    )
)
def cap_rescoring(spark, sf_dir):
    """Answers cut to so many words or characters and scored again, every cap from one pass over each answer, against the uncut ones."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", text.words(F.col("text")).alias("w"))
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("w").alias("gold"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("found"), F.col("text").alias("raw"))
    scores = rouge.capped_scores(user.join(reply, ["conv_id", "turn"]), "gold", "found", "raw", ["conv_id", "turn"], WORD_CAPS, CHAR_CAPS, text.words)
    board = scores.groupBy("unit", F.col("cap").cast("long").alias("cap")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.avg("rouge_l"), 6).alias("rouge_l"))
    board = stored(board)
    return analysis.against(board, board.where("unit = 'none'"), ["rouge_l"])


@query(
    over(
        f"""t AS (SELECT conv_id, turn, regexp_extract_all(text, '[ \\t\\n]+|[^ \\t\\n]+') AS toks FROM conversations),
k AS (SELECT *, list_filter(range(1, len(toks) + 1), lambda i: {STRIP.format('toks[i]')} <> '') AS spoken FROM t),
c AS (SELECT conv_id, turn, array_to_string(CASE WHEN len(spoken) > 12 THEN toks[1:spoken[13] - 1] ELSE toks END, '') AS cut FROM k)""",
        f"SELECT conv_id, turn, {STRIP.format('cut')} AS cut FROM c",
    )
)
def content_word_cut(spark, sf_dir):
    """Turns cut to twelve content words, the blanks between them kept."""
    tokens = F.regexp_extract_all("text", F.lit(r"[ \t\n]+|[^ \t\n]+"), F.lit(0))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.cut_content_words(tokens, 12).alias("cut"))


# -- citations

SPREAD = "list_reduce(coalesce({ps}, []::DOUBLE[]), lambda d, p: list_transform(range(1, len(d) + 2), lambda i: coalesce(d[i], 0.0) * (1 - p) + coalesce(d[i - 1], 0.0) * p), [1.0::DOUBLE])"


@query(
    over(
        EVIDENCE
        + f""", r AS (SELECT *, CAST(CASE WHEN rd = 1 THEN 1 WHEN rd <= 5 THEN {RATES}[rd] ELSE greatest(0.05, 0.1 * pow(0.8, rd - 5)) END AS DOUBLE) AS p FROM evidence WHERE rd <= 10),
a AS (SELECT doc_id, n_gold, list(p ORDER BY rd) FILTER (is_gold = 1) AS g, list(p ORDER BY rd) FILTER (is_gold = 0) AS o, sum(p) AS k FROM r GROUP BY doc_id, n_gold),
d AS (SELECT doc_id, n_gold, k, {SPREAD.format(ps='g')} AS h, {SPREAD.format(ps='o')} AS m FROM a)""",
        """SELECT doc_id, round(k, 6) AS expected_k, round(list_sum(list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(range(1, len(m) + 1), lambda j: h[i] * m[j] * (i - 1) / (n_gold + j - 1))))), 6) AS expected_iou FROM d""",
    )
)
def citation_expected_iou(spark, sf_dir):
    """What the citation model's IoU is on average over all its draws, over the first ten ranks."""
    return pools.expected_iou(_evidence(spark, sf_dir), RATES, 10).select("doc_id", F.round("expected_k", 6).alias("expected_k"), F.round("expected_iou", 6).alias("expected_iou"))


# -- words that are written together

#: A word is in the dictionary if it stands in at least three documents and in one of so many: the dictionary then holds
#: at most this many times the words of an average document, however large the table is.
ONE_IN = 1000


def counted_dictionary(docs: DataFrame) -> DataFrame:
    """The words that enough documents hold."""
    words = docs.select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stored(words.where(F.col("n") >= max(3, docs.count() // ONE_IN)).select("word"))


@query()
def dictionary_segmentation(spark, sf_dir):
    """Documents without the blanks between their words, cut into words again by a dictionary counted from the table; how many word ends are found."""
    docs = ev.spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    tokenize = segment.segmented(segment.dictionary(counted_dictionary(docs)), whole=None)
    rows = ev.stage(docs, ["doc_id"], w=text.words(F.col("text")))
    rows = rows.select("doc_id", "w", tokenize(F.array_join("w", "")).alias("t"))
    rows = rows.select("doc_id", "w", "t", segment.ends("w").alias("ew"), segment.ends("t").alias("et"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size("t").cast("long").alias("n_tokens"), F.size(F.array_intersect("ew", "et")).cast("long").alias("n_ends_found"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


# -- prompts, flags and texts looked up


@query(
    over(
        EVIDENCE
        + f""", c AS (SELECT e.doc_id, array_to_string(a.q, ' ') AS question, count(*) AS n, string_agg('[' || rd || '] ' || substring(a.ps[e.pos], 1, 400), chr(10) ORDER BY rd) AS shown, max(CASE WHEN rb = 1 THEN rd END) AS pick
  FROM evidence e JOIN asked a USING (doc_id) WHERE e.rd <= 10 GROUP BY e.doc_id, a.q)""",
        f"SELECT doc_id, n, md5('{prompts.PICK[0]}' || question || chr(10) || chr(10) || '{prompts.PICK[1].partition('{}')[0]}' || n || '{prompts.PICK[1].partition('{}')[2][:-1]}' || chr(10) || shown || chr(10) || chr(10) || replace('{prompts.PICK[2]}', chr(10), chr(10))) AS prompt_md5, CAST(pick AS INT) AS picked FROM c",
    )
)
def pick_prompt(spark, sf_dir):
    """Ten candidates by dense rank shown to a model that picks one; BM25's first choice stands in for its answer, if it is shown."""
    d = ev.scored(read(spark, sf_dir, "documents"))
    shown = F.slice(F.array_sort(F.transform("s", lambda x: F.struct(x["rd"].alias("rd"), x["rb"].alias("rb"), F.get("ps", x["pos"].cast("int") - 1).alias("text")))), 1, 10)
    d = ev.stage(d, ["doc_id", "q"], c=shown)
    first = F.get(F.filter("c", lambda x: x["rb"] == 1), F.lit(0))["rd"]
    answer = F.concat(first.cast("string"), F.lit("] because"))
    n = F.size("c")
    return d.select("doc_id", n.cast("long").alias("n"), F.md5(prompts.pick_prompt(F.array_join("q", " "), F.col("c.text"))).alias("prompt_md5"), citations.picked(answer, n).alias("picked"))


FLAGS = {"list": ["includes", "such as", ","], "summary": ["summary", "main point", "in short"], "number": ["one", "two", "three"], **{f"thai_{k}": v for k, v in text.KEYWORDS.items()}}


@query(over(ARRAYS, "SELECT doc_id, pos, " + ", ".join(f"({' OR '.join(f"contains(text, '{w}')" for w in words)}) AS has_{name}" for name, words in FLAGS.items()) + " FROM paras"))
def keyword_flags(spark, sf_dir):
    """Which kinds of key words each paragraph holds."""
    p = ev.paragraphs(read(spark, sf_dir, "documents"))
    return p.select("doc_id", "pos", text.keyword_flags(F.col("text"), FLAGS).alias("f")).select("doc_id", "pos", "f.*")


@query(over(ARRAYS + ", r AS (SELECT d.doc_id, unnest([1 + d.doc_id % 9, 1 + d.doc_id % 4]) AS pos FROM documents d)", "SELECT r.doc_id, r.pos, coalesce(p.text, '') AS text FROM r LEFT JOIN paras p ON r.doc_id = p.doc_id AND r.pos = p.pos"))
def text_lookup(spark, sf_dir):
    """The text that a reference names (here places made from the id); the empty text for one that names none."""
    docs = read(spark, sf_dir, "documents")
    refs = docs.select("doc_id", F.explode(F.array(1 + F.col("doc_id") % 9, 1 + F.col("doc_id") % 4)).alias("pos"))
    return inference.with_texts(refs, ev.paragraphs(docs), ["doc_id", "pos"])


@query(
    over(
        "t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<|channel>thought ' || text || '<channel|>' || text WHEN 1 THEN text || '<|channel>cut off ' || role WHEN 2 THEN ' ' || text || '<eos><|think|><turn|>' ELSE text || ' a < b > c' END AS raw FROM conversations)",
        rf"""SELECT conv_id, turn, {STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(raw, '(?s)<\|channel>.*?<channel\|>', '', 'g'), '(?s)<\|channel>.*$', '', 'g'), '<\|?[a-zA-Z_]+\|?>', '', 'g')".replace(chr(92) * 2, chr(92)))} AS answer FROM t""",
    )
)
def channel_strip(spark, sf_dir):
    """Answers without thoughts between channel marks, cut-off ones included, and without special tokens."""
    c, four = read(spark, sf_dir, "conversations"), F.col("turn") % 4
    raw = F.when(four == 0, F.concat(F.lit("<|channel>thought "), "text", F.lit("<channel|>"), "text")).when(four == 1, F.concat("text", F.lit("<|channel>cut off "), "role"))
    raw = raw.when(four == 2, F.concat(F.lit(" "), "text", F.lit("<eos><|think|><turn|>"))).otherwise(F.concat("text", F.lit(" a < b > c")))
    return c.select("conv_id", "turn", citations.without_channels(raw).alias("answer"))


# -- score artefacts

FOLDERS = {"dense": "exp01/eval_result", "bm25": "exp02/eval_result/s1ans_s2ref", "rrf": "exp02/eval_result/s2ans_s2ref"}


@query(
    over(
        EVIDENCE,
        """SELECT CASE system WHEN 'dense' THEN 'exp01' WHEN 'bm25' THEN 'exp02/s1ans_s2ref' ELSE 'exp02/s2ans_s2ref' END AS label, count(*) AS n, round(avg(rouge_l), 6) AS rouge_l, round(avg(ss), 6) AS ss, round(avg(iou), 6) AS iou,
round(0.45 * avg(ss) + 0.35 * avg(rouge_l) + 0.2 * avg(iou), 6) AS stored, count(*) AS n_scored, 'doc_' || system AS heldout_doc FROM detail GROUP BY system""",
    )
)
def score_artefacts_round_trip(spark, sf_dir):
    """Details and held-out summaries written to a tree of experiments' folders, found again and put side by side."""
    root, detail = scratch.folder(spark), stored(_detail(spark, sf_dir))
    for system, folder in FOLDERS.items():
        rows = detail.where(F.col("system") == system).select(F.col("doc_id").cast("string").alias("query_id"), "rouge_l", "ss", "iou")
        scores.write_scores(rows, f"{root}/{folder}", f"doc_{system}")
    means = scores.read_details(spark, root).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("rouge_l", "ss", "iou")))
    held = scores.read_held_out(spark, root).select("label", F.round("stored", 6).alias("stored"), "n_scored", "heldout_doc")
    return means.join(held, "label")


# -- late interaction over a cache of token vectors

WIDTH = 8
NARROW = TOKENS_AS_BUCKETS.replace("% 64", f"% {WIDTH}")


def two_places(tokens, distinct=False):
    """Each token as a vector with a one in one of the first WIDTH places and in one of the last; if asked for, each distinct one once."""
    digit = lambda h, i: F.instr(F.lit("0123456789abcdef"), F.substring(h, i, 1)) - 1
    one = lambda i, j: F.array(*(F.lit(float(x in (i, WIDTH + j))).cast("float") for x in range(2 * WIDTH)))
    table = F.array(*(one(i, j) for i in range(WIDTH) for j in range(WIDTH)))
    # WIDTH divides 16: four hex digits modulo WIDTH are the last one's remainder
    at = F.transform(F.transform(tokens, F.md5), lambda h: (digit(h, 4) % WIDTH) * WIDTH + digit(h, 8) % WIDTH)
    return F.transform(F.array_distinct(at) if distinct else at, lambda i: F.get(table, i))


@query(
    over(
        EVIDENCE
        + f""", sims AS (
  SELECT doc_id, pos, coalesce(list_sum(list_transform({NARROW.format('q')}, lambda a: coalesce(list_max(list_transform({NARROW.format('toks')}, lambda b: CAST(a[1] = b[1] AS INT) + CAST(a[2] = b[2] AS INT))), 0))), 0) AS s FROM ptoks),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, pos) AS rank FROM sims)""",
        "SELECT doc_id, pos, rank, CAST(s AS DOUBLE) AS score FROM r WHERE rank <= 5",
    )
)
def late_interaction_cached(spark, sf_dir):
    """Token vectors (a paragraph's distinct ones: repeats change no maximum) written to the cache, read back, coded and ranked by MaxSim: each question's five best paragraphs."""
    docs, path = ev.spread(read(spark, sf_dir, "documents").select("doc_id", "text")), scratch.folder(spark)
    sinks.write_vectors(ev.paragraphs(docs).select("doc_id", "pos", two_places(F.array_distinct("tokens"), distinct=True).alias("vectors")), path)
    cache = corpus.read_vectors(spark, path, "doc_id long, pos long, vectors array<array<float>>")
    asked = ev.questioned(docs).select(F.col("doc_id").alias("query_id"), "doc_id", two_places(F.col("q")).alias("vectors"))
    return late.ranked(asked, cache, 5).select(F.col("query_id").alias("doc_id"), "pos", "rank", "score")
