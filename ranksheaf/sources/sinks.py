"""Writers of submissions, details, summaries and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission(predictions: DataFrame) -> DataFrame:
    """ID, abstractive, refs (comma-joined) in the original order of the queries."""
    return predictions.orderBy("query_ord").select(F.col("query_id").alias("ID"), F.col("answer").alias("abstractive"), F.array_join("refs", ",").alias("refs"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def write_submission(predictions: DataFrame, path: str) -> None:
    write_csv(submission(predictions), path)


def write_combinations(predictions: DataFrame, path: str) -> None:
    """One folder per combination of answer and evidence stage."""
    rows = predictions.select("combo", F.col("query_id").alias("ID"), F.col("answer").alias("abstractive"), F.array_join("refs", ",").alias("refs"))
    rows.repartition("combo").write.mode("overwrite").partitionBy("combo").options(header=True, quoteAll=True, escape='"').csv(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A vector cache of single or multi-vectors, as Parquet."""
    vectors.write.mode("overwrite").parquet(path)


def write_detail(detail: DataFrame, path: str) -> None:
    write_csv(detail.select("query_id", "rouge_l", "ss", "iou"), path)


def write_json(df: DataFrame, path: str) -> None:
    """A summary or an experiment's result as JSON lines."""
    df.write.mode("overwrite").json(path)


def leaderboard_markdown(board: DataFrame, notes: str = "") -> str:
    """Three sections sorted by composite, answer part and evidence part. The board has one row a system, so it is small."""
    parts = []
    for title, column in (("Composite", "composite"), ("Answer", "answer_sub"), ("Evidence", "iou")):
        rows = board.orderBy(F.desc(column), "system").select("system", "rouge_l", "ss", "iou", "composite").toLocalIterator()
        lines = [f"| {r['system']} | " + " | ".join(f"{r[c]:.4f}" for c in ("rouge_l", "ss", "iou", "composite")) + " |" for r in rows]
        parts.append("\n".join([f"## {title}", "", "| system | RougeL | SS | IoU | composite |", "|---|---|---|---|---|", *lines]))
    return "\n\n".join([*parts, *([f"## Notes\n\n{notes}"] if notes else [])]) + "\n"
