import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from conftest import SMALL
from helpers import SMALLER, no_documents, odd_documents
from oracle import assert_same
from ranksheaf.llm import line_dedup, registry

LEAST_LONG = -(1 << 63)


def brute(rows, least=20, documents=3):
    """doc_id, n_lines, n_dropped, kept text of each row."""
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(SMALLER)
    name = lambda d: LEAST_LONG if d is None else d
    holds = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            holds[key(x)].add(name(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keeps = [len(k := key(x)) < least or len(holds[k]) < documents or max(holds[k]) == name(d) for x in lines]
        out.append((d, len(lines), keeps.count(False), sha256("\n".join(x for x, s in zip(lines, keeps, strict=True) if s).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=repr)


def test_agrees_with_sql(spark):
    assert_same(registry.op11_line_dedup(spark, SMALL), registry.ORACLE_SQL["op11_line_dedup"], SMALL)


@pytest.mark.parametrize("parts", [None, 1, 2, 7, 40])
def test_boundaries_fall_anywhere(spark, parts):
    """A key that most lines share is cut into many partitions, within documents and between them."""
    common, pair = "this line stands in every document", "this one stands in two documents only"
    rows = []
    for i in range(120):
        lines = [f"  {common.upper() if i % 3 else common}\t"] * (1 + i % 5) + [f"line {i // k} of a family of {k} documents" for k in (1, 2, 3, 4, 30)] + ["short", ""]
        rows.append((i, "\n".join(lines + [pair] * (i in (7, 90)) + [f"repeated within document {i} alone"] * 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(line_dedup.line_dedup(df, parts=parts)) == brute(rows)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
@pytest.mark.parametrize("parts", [None, 6])
def test_odd_cases(spark, parts, broadcast_bytes):
    docs = odd_documents(spark)
    same = "Ünïcode line of twenty-odd characters"
    more = [(20, f"{same}\n\x0bx\r\n{same}"), (21, f" {same}\r"), (None, same), (22, "\n"), (21, f"{same}\nother text of one id"), (23, "Ünïcode line of twenty"[:19] + "\n" + "exactly twenty chars"), (24, "exactly twenty chars"), (25, "EXACTLY twenty chars")]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + more
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' AS d", "1 AS t", "2 AS pos", "3 AS n_dropped", "4 AS keep_bitmap")
    assert found(line_dedup.line_dedup(df, parts=parts, broadcast_bytes=broadcast_bytes)) == brute(rows)
    assert line_dedup.line_dedup(no_documents(spark)).count() == 0


def test_bitmaps_say_what_stays(spark):
    rows = [(i, "a line that stands everywhere\nown\na line that stands everywhere" + "\nmore" * i) for i in range(5)]
    for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id == 4:
            assert r.keep_bitmap is None and r.n_dropped == 0
        else:
            assert np.unpackbits(np.frombuffer(zlib.decompress(r.keep_bitmap), np.uint8), bitorder="little").tolist()[:3] == [0, 1, 0] and r.n_dropped == 2


def test_a_text_of_many_lines(spark):
    long = "\n".join(f"line number {i % 5000} of a very long text" for i in range(60_000))
    rows = [(1, long), (2, long), (3, "line number 7 of a very long text"), (4, None)]
    assert found(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), parts=9)) == brute(rows)


def test_texts_are_not_shuffled_behind_a_small_broadcast(spark):
    plan = line_dedup.line_dedup(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("SortMergeJoin|Exchange hashpartitioning", plan)
