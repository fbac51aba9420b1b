import ast
from pathlib import Path

import __spark_entry__
import pytest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
FAST = ("foot_points", "project_tracks", "smooth_ball", "possession_states", "vote_labels", "stage_plan", "pitch_vertices")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "turfline").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = __spark_entry__.queries()[name](spark, SF)
    found = con.sql(__spark_entry__.oracle_sql()[name])
    at = [found.columns.index(c) for c in df.columns]
    text = lambda rows: sorted(str(tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r)) for r in rows)
    assert text(tuple(r) for r in df.collect()) == text(tuple(r[i] for i in at) for r in found.fetchall())
