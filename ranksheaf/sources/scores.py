"""Score artefacts of experiments: a tree of folders with details and held-out summaries, read, written and laid out.

An experiment's folder is ``exp<name>/eval_result`` or, for a combination of answer and evidence stage, one folder
below it. It holds ``train_eval_detail.csv`` (a row a question) and ``train_eval_score_heldout.json`` (one object); each
may be a single file or a folder that Spark wrote. Reading lists the tree once; experiment and combination are columns
from the path, and files of other names are pruned before any is opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import WEIGHTS, answer_part, composite
from .sinks import write_csv

DETAIL, HELD_OUT = "train_eval_detail.csv", "train_eval_score_heldout.json"
COLUMNS = {"ID": "query_id", "rougeL": "rouge_l", "SS-score": "ss", "IoU": "iou"}
#: The headings of a leaderboard and where its kept part begins.
HEADINGS = (("composite", "## Sorted by composite"), ("answer_sub", "## Sorted by 0.35·RougeL + 0.45·SS (answer-quality only, IoU excluded)"), ("iou", "## Sorted by IoU"))
TABLE = "| Exp | Model | RougeL | SS | IoU | Composite | 0.35RL+0.45SS | src |\n|-----|-------|--------|------|------|-----------|---------------|-----|"
NOTES = "## Notes"


def _labelled(files: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """keep with exp, combo (null for the standard folder) and label of the rows whose file has the name."""
    shape = rf"/(exp[^/]*)/eval_result/(?:([^/]+)/)?{name.replace('.', '[.]')}(?:/[^/]+)?$"
    path = F.col("_metadata.file_path")
    rows = files.where(path.rlike(shape)).select(*keep, F.regexp_extract(path, shape, 1).alias("exp"), F.nullif(F.regexp_extract(path, shape, 2), F.lit("")).alias("combo"))
    return rows.withColumn("label", F.concat_ws("/", "exp", "combo"))


def read_details(spark: SparkSession, root: str) -> DataFrame:
    """query_id, rouge_l, ss, iou, exp, combo, label of every detail file below root."""
    schema = ", ".join(f"`{c}` {'string' if c == 'ID' else 'double'}" for c in COLUMNS)
    files = spark.read.schema(schema).options(header=True, recursiveFileLookup=True, pathGlobFilter="*.csv").csv(root)
    return _labelled(files, DETAIL, [F.col(f"`{c}`").alias(name) for c, name in COLUMNS.items()])


def read_held_out(spark: SparkSession, root: str) -> DataFrame:
    """rouge_l, ss, iou, stored (the score), n_scored, heldout_doc, exp, combo, label of every held-out summary below root."""
    schema = "rougeL double, `SS-score` double, IoU double, score double, n_scored long, heldout_doc string"
    files = spark.read.schema(schema).options(multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json").json(root)
    names = [*(F.col(f"`{c}`").alias(n) for c, n in COLUMNS.items() if c != "ID"), F.col("score").alias("stored"), "n_scored", "heldout_doc"]
    return _labelled(files, HELD_OUT, names)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_scores(detail: DataFrame, folder: str, heldout_doc: str | None = None) -> None:
    """A detail and its summary, both or neither: they are written beside the folder, which then takes its name.

    detail: query_id, rouge_l, ss, iou. A folder that is there is replaced. Details of no rows have null means.
    """
    spark, part = detail.sparkSession, f"{folder.rstrip('/')}.part-{uuid.uuid4().hex}"
    back = {name: c for c, name in COLUMNS.items()}
    write_csv(detail.select(*(F.col(name).alias(c) for name, c in back.items())), f"{part}/{DETAIL}")
    means = detail.agg(F.count(F.lit(1)).alias("n_scored"), *(F.avg(c).alias(c) for c in WEIGHTS))
    score = composite(*(F.col(c) for c in WEIGHTS))
    summary = means.select(*(F.col(c).alias(back[c]) for c in WEIGHTS), score.alias("score"), "n_scored", F.lit(heldout_doc).cast("string").alias("heldout_doc"))
    summary.coalesce(1).write.json(f"{part}/{HELD_OUT}")
    files, at = _file_system(spark, folder)
    files.mkdirs(at.getParent())
    files.delete(at, True)
    if not files.rename(_file_system(spark, part)[1], at):
        raise OSError(f"{part} could not become {folder}")


def markdown(board: DataFrame, kept: str = "") -> str:
    """The leaderboard in three orders, each with footnotes on scores that disagree, and the kept notes.

    board: label, model, rouge_l, ss, iou, composite, stored, source, flag; one row a system, so it is small.
    """
    rows = board.withColumn("answer_sub", answer_part(F.col("rouge_l"), F.col("ss")))
    parts = []
    for column, title in HEADINGS:
        lines, foot = [title, "", TABLE], []
        for r in rows.orderBy(F.desc(column), "label").toLocalIterator():
            mark = " ⚠" if r["flag"] else ""
            lines.append(f"| {r['label']} | {r['model']} | {r['rouge_l']:.4f} | {r['ss']:.4f} | {r['iou']:.4f} | {r['composite']:.4f}{mark} | {r['answer_sub']:.4f} | {r['source']} |")
            if r["flag"]:
                foot.append(f"> - **{r['label']}**: stored = {r['stored'] or 0.0:.4f}; using `{r['source']}` — {r['flag']}")
        parts.append("\n".join([*lines, *(["", "> ⚠ the score shown is the one to use; the stored one differs:", *foot] if foot else [])]))
    return "\n\n".join([*parts, *([kept.strip()] if kept else [])]) + "\n"


def write_leaderboard(board: DataFrame, folder: str) -> None:
    """scores.json (a row a system) and scores.md in a folder; what an earlier scores.md has from its notes on is kept."""
    spark = board.sparkSession
    files, at = _file_system(spark, f"{folder}/scores.md")
    old = "\n".join(r.value for r in spark.read.text(f"{folder}/scores.md", wholetext=True).collect()) if files.exists(at) else ""
    text = markdown(board, old[old.index(NOTES) :] if NOTES in old else "")
    board.orderBy(F.desc("composite"), "label").coalesce(1).write.mode("overwrite").json(f"{folder}/scores.json")
    files.setWriteChecksum(False)  # people edit the notes, and a local store would then refuse the file
    try:
        out = files.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
    finally:
        files.setWriteChecksum(True)
