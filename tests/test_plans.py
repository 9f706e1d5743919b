"""What Catalyst makes of the plans: pushdown, pruning, group limits, few exchanges."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeseam.operators import graph, ranking, search
from lodeseam.plans.catalog import QUERIES
from lodeseam.schemas import as_hits

DATA = Path(os.environ.get("LODESEAM_TEST_TABLES", "/root/testdata/sf0.001"))
needs_tables = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning") + plan(df).count("Exchange SinglePartition")


@needs_tables
def test_line_search_reads_two_columns_and_pushes_the_literal(spark):
    p = plan(QUERIES["exact_lines"](spark, str(DATA)))
    assert "StringContains(text,index)" in p and "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in p and "Exchange" not in p


def test_find_hybrid_runs_the_engines(spark, tmp_path):
    """All terms of the query count, structure is found in the text, and the query's vector decides what is semantic."""
    rows = [
        ("c1", "/srv/checkouts/p/a.py", 1, "def get(key):\n    return cache[key]\n", "function", None),
        ("c2", "/srv/checkouts/p/b.py", 1, "x = 1\nclass Apple:\n    pass\n", "function", None),
        ("c3", "/srv/checkouts/p/c.py", 1, "def pear():\n    return 2\n", "function", "Nothing that the question asks for, but a docstring of more than forty characters."),
        ("c4", "/srv/checkouts/p/d.py", 1, "def where_do_we_load_the_window_cache():\n    return None\n", "function", None),
    ]
    table = spark.createDataFrame(rows, "chunk_id string, file_path string, start_line int, content string, chunk_type string, docstring string")
    none = {"symbols": "array<string>", "language": "string", "last_modified": "double", "parent_symbol": "string", "imports": "array<string>", "calls": "array<string>", "inherits": "array<string>", "project": "string"}
    table = table.withColumns({"end_line": F.lit(3), "indexed_at": F.lit(1.0), **{k: F.lit(None).cast(t) for k, t in none.items()}})
    table.write.parquet(str(tmp_path / "code_chunks.parquet"))
    got = {r["file_path"][-4:]: r for r in QUERIES["find_hybrid"](spark, str(tmp_path)).collect()}
    assert got["a.py"]["source"] in ("grep", "hybrid")
    assert got["b.py"]["source"] in ("ast", "hybrid")
    assert got["d.py"]["source"] == "hybrid" and got["d.py"]["rank"] == 1
    assert "c.py" not in got or got["c.py"]["score"] < got["d.py"]["score"]


@needs_tables
def test_merge_shuffles_by_file_once(spark):
    p = plan(QUERIES["hybrid_merge"](spark, str(DATA)))
    assert p.count("Exchange hashpartitioning(file_path") == 1 and "CartesianProduct" not in p and "NestedLoop" not in p


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_joins_without_keys(spark, name):
    p = plan(QUERIES[name](spark, str(DATA)))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_caps_become_group_limits(spark):
    hits = as_hits(spark.createDataFrame([(1, "a", 1, 2, 0.5)], "query_id bigint, file_path string, start_line int, end_line int, score double"))
    assert "WindowGroupLimit" in plan(ranking.cap_per_file(hits)) and "WindowGroupLimit" in plan(ranking.top_hits(hits, 5))
    assert exchanges(ranking.cap_per_file(hits)) == 1


def test_lookups_are_equi_joins(spark):
    edges = spark.createDataFrame([("a", "b", "call", "f")], "source string, target string, edge_type string, source_file string")
    p = plan(graph.callers_of(edges, spark.createDataFrame([("b",)], "symbol string")))
    assert "NestedLoop" not in p and "Join" in p


def test_scores_need_no_shuffle(spark):
    hits = as_hits(spark.createDataFrame([("a", 1, 2)], "file_path string, start_line int, end_line int"))
    assert exchanges(ranking.score_hits(hits, F.lit("some query"), 0.0)) == 0
    assert exchanges(search.lines_of(spark.createDataFrame([("a", "b")], "file_path string, content string"))) == 0
