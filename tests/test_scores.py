import json

import pytest

from ranksheaf.operators import analysis
from ranksheaf.sources import scores

DETAIL = "query_id string, rouge_l double, ss double, iou double"


def detail(spark, rows):
    return spark.createDataFrame(rows, DETAIL)


def test_a_tree_of_experiments(spark, tmp_path):
    """Single files as another program writes them, folders as Spark does, and files that are none of these."""
    root = str(tmp_path)
    scores.write_scores(detail(spark, [("q1", 0.5, 0.25, 1.0), ("q2", 1.0, 0.75, 0.0)]), f"{root}/exp7/eval_result/s1ans_s2ref", "doc_9")
    plain = tmp_path / "exp8" / "eval_result"
    plain.mkdir(parents=True)
    (plain / scores.DETAIL).write_text('ID,rougeL,SS-score,IoU\n"q,1",0.25,0.5,0.75\n')
    (plain / scores.HELD_OUT).write_text(json.dumps({"rougeL": 0.1, "SS-score": 0.2, "IoU": 0.3, "score": 0.4, "n_scored": 5, "heldout_doc": "d"}, indent=2))
    (plain / "other.csv").write_text("ID,rougeL,SS-score,IoU\nx,9,9,9\n")
    (tmp_path / "train_eval_detail.csv").write_text("ID,rougeL,SS-score,IoU\ny,9,9,9\n")
    rows = {(r.label, r.query_id): (r.exp, r.combo, r.rouge_l, r.ss, r.iou) for r in scores.read_details(spark, root).collect()}
    assert rows == {
        ("exp7/s1ans_s2ref", "q1"): ("exp7", "s1ans_s2ref", 0.5, 0.25, 1.0), ("exp7/s1ans_s2ref", "q2"): ("exp7", "s1ans_s2ref", 1.0, 0.75, 0.0),
        ("exp8", "q,1"): ("exp8", None, 0.25, 0.5, 0.75),
    }
    held = {r.label: r for r in scores.read_held_out(spark, root).collect()}
    assert (held["exp8"].stored, held["exp8"].n_scored, held["exp8"].heldout_doc) == (0.4, 5, "d")
    assert held["exp7/s1ans_s2ref"].n_scored == 2 and held["exp7/s1ans_s2ref"].stored == pytest.approx(0.45 * 0.5 + 0.35 * 0.75 + 0.2 * 0.5)


def test_detail_and_summary_come_together(spark, tmp_path):
    folder = f"{tmp_path}/exp1/eval_result"
    scores.write_scores(detail(spark, [("a", 1.0, 1.0, 1.0)]), folder)
    broken = detail(spark, [("b", 0.5, 0.5, 0.5)]).selectExpr("query_id", "rouge_l", "ss", "raise_error('lost') AS iou")
    with pytest.raises(Exception, match="lost"):
        scores.write_scores(broken.selectExpr("query_id", "rouge_l", "ss", "CAST(iou AS double) AS iou"), folder)
    assert [r.query_id for r in scores.read_details(spark, str(tmp_path)).collect()] == ["a"]
    assert scores.read_held_out(spark, str(tmp_path)).count() == 1
    scores.write_scores(detail(spark, []), folder)
    assert scores.read_details(spark, str(tmp_path)).count() == 0
    assert scores.read_held_out(spark, str(tmp_path)).first().n_scored == 0


def test_leaderboard_keeps_its_notes_and_marks_what_disagrees(spark, tmp_path):
    rows = [("exp1", "m", 0.5, 0.5, 0.5, 0.5, 0.7, "detail", "disagrees"), ("exp2", "?", 0.9, 0.1, 0.2, 0.4, None, "detail", ""), ("exp3", "m", 0.1, 0.1, 0.9, 0.26, 0.26, "stored", "")]
    board = spark.createDataFrame(rows, "label string, model string, rouge_l double, ss double, iou double, composite double, stored double, source string, flag string")
    scores.write_leaderboard(board, str(tmp_path))
    md = tmp_path / "scores.md"
    first = md.read_text()
    order = [[x.split("|")[1].strip() for x in part.split("\n") if x.startswith("| exp")] for part in first.split("## Sorted")[1:]]
    assert order == [["exp1", "exp2", "exp3"], ["exp1", "exp2", "exp3"], ["exp3", "exp1", "exp2"]]
    assert first.count("0.5000 ⚠") == 3 and first.count("> - **exp1**: stored = 0.7000; using `detail` — disagrees") == 3
    md.write_text(first + "\n## Notes\n\nkept by hand\n")
    scores.write_leaderboard(board.where("label <> 'exp1'"), str(tmp_path))
    again = md.read_text()
    assert again.endswith("## Notes\n\nkept by hand\n") and "⚠" not in again and again.count("## Notes") == 1
    stored = spark.read.json(f"{tmp_path}/scores.json")
    assert [r.label for r in stored.collect()] == ["exp2", "exp3"]
    assert analysis.answer_part(board["rouge_l"], board["ss"]) is not None
