import os
import subprocess
import sys

import pytest

from conftest import ROOT, SMALL
from oracle import assert_same
from ranksheaf.plans import additions, extras, mechanisms, registry, studies  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SMALL), registry.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_hinted_prompts_hold_the_documents(spark):
    context = {r.doc_id: r.context for r in registry.QUERIES["prompt_context"](spark, SMALL).collect()}
    short = {r.doc_id: r.prompt for r in registry.QUERIES["hint_prompt"](spark, SMALL).collect()}
    rows = registry.QUERIES["hint_prompt_full"](spark, SMALL).collect()
    assert len(rows) == len(short) > 0
    for r in rows:
        asked = short[r.doc_id].partition("\n\n")[2]
        assert r.prompt == f"Context:\n{context[r.doc_id]}\n\n{asked}"


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_entry_works_without_the_optional_part(tmp_path, kept):
    import shutil

    shutil.copytree(ROOT / "ranksheaf", tmp_path / "ranksheaf", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(k for k in kept if (ROOT / k).exists())):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q; assert not set(e.oracle_sql()) - set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "ranksheaf").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("llm_rerank", ""), p
