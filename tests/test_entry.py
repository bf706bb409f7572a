"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

REPO = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_runs_without_the_operators(tmp_path):
    shutil.copytree(REPO / "loam", tmp_path / "loam", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(s) <= set(q) and not [k for k in q if k.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_operators():
    for p in (REPO / "loam").rglob("*.py"):
        if "llm" not in p.parts:
            assert "loam.llm" not in p.read_text(), p


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["corpus_gate_static", "safety_filter", "url_parts", "similarity_graph", "contradictions", "safety_fsm", "think_strip", "star_rollup"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    norm = lambda rows: sorted(repr([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)
    got = e.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert norm(got.select(*cols).collect()) == norm(rel.fetchall())
