"""Evaluation over questions and systems: paired comparison, counts, buckets, correlation, thresholds, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations
from . import quantiles

TIE, DISAGREE = 1e-9, 0.0005
WEIGHTS = {"rouge_l": 0.35, "ss": 0.45, "iou": 0.20}


def composite(rouge_l: Column, ss: Column, iou: Column) -> Column:
    return WEIGHTS["ss"] * ss + WEIGHTS["rouge_l"] * rouge_l + WEIGHTS["iou"] * iou


def answer_part(rouge_l: Column, ss: Column) -> Column:
    return WEIGHTS["rouge_l"] * rouge_l + WEIGHTS["ss"] * ss


def summary(detail: DataFrame, keys: list[str]) -> DataFrame:
    """Means of the metrics, the composite and the answer part."""
    means = detail.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in WEIGHTS))
    r, s, i = (F.col(c) for c in WEIGHTS)
    return means.select(*keys, "n", *(F.round(F.col(c), 6).alias(c) for c in WEIGHTS), F.round(composite(r, s, i), 6).alias("composite"), F.round(answer_part(r, s), 6).alias("answer_sub"))


def held_out(detail: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """detail without the rows of held-out names."""
    return detail.join(names.select(column), column, "left_anti")


def outcomes(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Wins, ties and losses of b against a."""
    d = F.col(b) - F.col(a)
    return pairs.groupBy(*keys).agg(F.count_if(d > TIE).alias("wins"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.count_if(d < -TIE).alias("losses"), F.round(F.avg(d), 6).alias("mean_delta"))


def micro_prf(pairs: DataFrame, gold: str, found: str, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 over all pairs of sets together."""
    tp, fp, fn = F.sum(F.size(F.array_intersect(gold, found))), F.sum(F.size(F.array_except(found, gold))), F.sum(F.size(F.array_except(gold, found)))
    s = pairs.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return s.select(*keys, "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return [r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1")]


def percentiles(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Count, mean, population deviation, linear percentiles and extremes; a hot group is cut by value."""
    plain = df.groupBy(*keys).agg(F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_pop(column), 6).alias("std"), F.min(column).alias("least"), F.max(column).alias("most"))
    both = quantiles.matched(plain, quantiles.linear(df, column, keys, [0.5, 0.9, 0.95, 0.99]), keys, "left")
    return both.select(*keys, F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "std", *(F.round(F.col("p")[i], 6).alias(name) for i, name in enumerate(("p50", "p90", "p95", "p99"))), "least", "most")


def index_percentile(df: DataFrame, column: str, keys: list[str], share: float) -> DataFrame:
    """The value at floor(share * n) of the sorted values, clamped, per group; a hot group is cut by value."""
    at = lambda n: F.array(F.least(F.floor(F.lit(share) * n).cast("long") + 1, n))
    kind = dict(df.dtypes)[column]
    return quantiles.at_ranks(df, column, keys, at).select(*keys, F.get("found", F.lit(0)).cast(kind).alias("value"))


def over_budgets(df: DataFrame, column: str, budgets: list[int]) -> DataFrame:
    """How many rows are over each budget."""
    rows = df.withColumn("budget", F.explode(F.array(*(F.lit(b).cast("long") for b in budgets))))
    return rows.groupBy("budget").agg(F.count_if(F.col(column) > F.col("budget")).alias("over"), F.count(F.lit(1)).alias("n"))


def binned(df: DataFrame, value: Column, edges: list[float], measures: list[Column]) -> DataFrame:
    """Measures per half-open bin; empty bins are there too."""
    bins = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin long, low double, high double")
    at = F.lit(None).cast("long")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        at = F.when((value >= a) & (value < b), F.lit(i).cast("long")).otherwise(at)
    found = df.withColumn("bin", at).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *measures)
    return F.broadcast(bins).join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def correlation(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Pearson's r; 0 if either side is constant."""
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return s.select(*keys, "n", F.round(F.coalesce(F.try_divide(F.col("c"), F.col("sa") * F.col("sb")), F.lit(0.0)), 6).alias("r"))


def rank_sum_auc(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """Area under the curve by the rank sum, the better of both directions; 0.5 with one class. Ties count half."""
    s = quantiles.rank_sums(df, score, label, keys)
    n = F.col("all") - F.col("p")
    auc = F.coalesce(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * n).cast("double")), F.lit(0.5))
    return s.withColumn("a", auc).select(*keys, F.col("p").alias("positives"), n.alias("negatives"), F.round(F.greatest("a", 1 - F.col("a")), 6).alias("auc"))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The best of 19 percentiles in two directions by accuracy, with its confusion counts."""
    shares = [round(0.05 * i, 2) for i in range(1, 20)]
    cuts = quantiles.linear(df, score, [], shares).select(F.posexplode("p").alias("i", "cut"))
    rows = df.select(score, label).join(F.broadcast(cuts)).withColumn("above", F.explode(F.array(F.lit(True), F.lit(False))))
    yes = F.when(F.col("above"), F.col(score) > F.col("cut")).otherwise(F.col(score) <= F.col("cut"))
    truth = F.col(label) == 1
    per = rows.groupBy("i", "cut", "above").agg(*confusion(truth, yes))
    per = per.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6))
    return per.orderBy(F.desc("accuracy"), "i", F.desc("above")).limit(1)


def confusion(truth: Column, found: Column) -> list[Column]:
    return [F.count_if(truth & found).alias("tp"), F.count_if(~truth & found).alias("fp"), F.count_if(truth & ~found).alias("fn"), F.count_if(~truth & ~found).alias("tn")]


def any_of(*flags: Column) -> Column:
    """The OR rule: yes if any flag says so; a missing flag says no."""
    found = F.lit(False)
    for f in flags:
        found = found | F.coalesce(f, F.lit(False))
    return found


def run_report(answers: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """Answers of a run, those that carry a citation tag, tags an answer, and how long answers are."""
    size, tags = F.length(raw), F.regexp_count(raw, F.lit(citations.TAG))
    return answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(citations.has_citation(F.col(raw))).alias("tagged"), F.round(F.avg(tags), 6).alias("mean_tags"),
        F.round(F.avg(size), 6).alias("mean_chars"), F.min(size).cast("long").alias("least"), F.max(size).cast("long").alias("most"),
    )


def bucket_summary(df: DataFrame, delta: str, keys: list[str]) -> DataFrame:
    """Per bucket: number, mean and median of the difference, wins and losses."""
    d = F.col(delta)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.percentile(d, F.lit(0.5)), 6).alias("median"), F.count_if(d > TIE).alias("wins"), F.count_if(d < -TIE).alias("losses"))


def with_predictions(gold: DataFrame, predictions: DataFrame, key: str, column: str) -> DataFrame:
    """gold with its prediction; a gold row that none answers fails the job instead of going missing."""
    both = gold.join(predictions.select(key, F.col(column).alias("_p"), F.lit(True).alias("_met")), key, "left")
    kind = dict(predictions.dtypes)[column]
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast(kind)
    return both.select(*gold.columns, F.when(F.col("_met"), F.col("_p")).otherwise(missing).alias(column))


def reconciled(computed: DataFrame, stored: DataFrame, labels: DataFrame, key: str = "system") -> DataFrame:
    """Leaderboard rows: the fixed score where there is one, else the mean of details, else what is stored; disagreements are flagged."""
    both = computed.join(stored, key, "full").join(labels, key, "left")
    source = F.when(F.coalesce("has_fixed", F.lit(False)) & F.col("stored").isNotNull(), "fixed").when(F.col("composite").isNotNull(), "detail").otherwise("stored")
    value = F.when(source == "detail", F.col("composite")).otherwise(F.col("stored"))
    flag = F.when(F.abs(F.col("composite") - F.col("stored")) > DISAGREE, F.lit("disagrees")).otherwise(F.lit(""))
    return both.select(key, F.coalesce("model", F.lit("?")).alias("model"), source.alias("source"), F.round(value, 4).alias("composite"), flag.alias("flag"))


def against(board: DataFrame, base: DataFrame, columns: list[str]) -> DataFrame:
    """board minus the one-row baseline."""
    one = base.select(*(F.col(c).alias(f"_{c}") for c in columns))
    return board.join(F.broadcast(one)).withColumns({f"delta_{c}": F.round(F.col(c) - F.col(f"_{c}"), 6) for c in columns}).drop(*(f"_{c}" for c in columns))
