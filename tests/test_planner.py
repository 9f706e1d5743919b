import pytest
from pyspark.sql import functions as F

from lodeseam.functions import text as tx
from lodeseam.operators.ranking import RankWeights
from lodeseam.plans.planner import expand_query, expanded_queries, expansions, grep_token, plan_columns, plan_query

CASES = [
    ('"exact text"', "exact", True, "exact text"),
    ("foo.*bar", "exact", False, "foo.*bar"),
    ("where do we validate the login token of users", "semantic", False, None),
    ("UserManager", "hybrid", False, "UserManager"),
    ("how does UserManager load", "hybrid", False, "UserManager"),
    ("", "exact", False, None),
]


@pytest.mark.parametrize("query,mode,fixed,pattern", CASES)
def test_plan(query, mode, fixed, pattern):
    plan = plan_query(query)
    assert (plan.mode, plan.grep_fixed) == (mode, fixed)
    if pattern and mode != "exact":
        assert plan.grep_pattern == pattern
    if mode == "semantic":
        assert plan.grep_pattern is None and plan.semantic_query == query


def test_plan_options():
    assert plan_query("some text here now", grep_only=True, semantic_only=True).grep_pattern == "some text here now"
    assert plan_query("load", semantic_only=True).mode == "semantic"
    assert plan_query("load", strategy="grep").mode == "exact"
    only = plan_query("", ast_patterns=("f($X)",))
    assert only.run_ast and only.ast_exhaustive and not only.run_grep and only.confidence == 0.5
    assert plan_query("x", ast_patterns=("f($X)",), strategy="codemod").confidence == 0.9
    with pytest.raises(ValueError):
        plan_query("x", strategy="codemod")
    assert not plan_query("").run_grep
    assert plan_query("foo|bar", precise=True).confidence == 0.8
    assert "grep" in plan_query("UserManager").describe()


def test_batch_plans_agree(spark):
    queries = [c[0] for c in CASES] + ["a_b", "x", "render.*edge", "find 'it' now", "config.yaml settings", "¿dónde está?", "the and or", None]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").withColumn("p", plan_columns(F.col("q"))).collect()
    for r in rows:
        plan = plan_query(r["q"] or "")
        assert (r["p"]["mode"], r["p"]["grep_pattern"], r["p"]["grep_fixed"]) == (plan.mode, plan.grep_pattern, plan.grep_fixed), r["q"]
        assert r["p"]["confidence"] == pytest.approx(plan.confidence)


def test_tokens_and_expansion(spark):
    assert grep_token("where is parse_tree used") == "parse_tree"
    assert grep_token("to be") is None
    assert grep_token("find the longest word") == "longest"
    assert expand_query("login") == ["login"]
    got = expand_query("how does auth flow work")
    assert got[0] == "how does auth flow work" and len(got) == 5 and got[1] == "how does authentication flow work"
    rows = spark.createDataFrame([("how does auth flow work",), ("login",), ("where cache",)], "q string").select("q", expansions(F.col("q")).alias("e")).collect()
    assert all(r["e"] == expand_query(r["q"]) for r in rows)
    cache: dict = {}
    assert expanded_queries("x y z", lambda q: ["a", "x y z"], cache) == ["x y z", "a"] and cache
    assert expanded_queries("x y z", lambda q: None) == ["x y z"]


def test_profile(spark):
    rows = [("getUser", "identifier"), ("how do we find it in there", "natural_language"), ("a b c d.*", "pattern"), ("", "identifier"), (None, "identifier")]
    got = spark.createDataFrame([(q,) for q, _ in rows], "q string").select(tx.query_profile(F.col("q")).alias("p")).collect()
    assert [r["p"]["query_type"] for r in got] == [k for _, k in rows]
    assert got[3]["p"]["confidence"] == 0.5


def test_weights():
    w = RankWeights.from_env({"LODESEAM_RANK_GREP": "0.9", "LODESEAM_RANK_AST": "x"})
    assert w.grep == 0.9 and w.ast == 0.15
    assert w.with_overrides(semantic=0.1, grep=None).semantic == 0.1
    a = RankWeights().adapted("identifier", 0.5)
    assert a.semantic == pytest.approx(0.35) and a.grep == pytest.approx(0.5)
    assert RankWeights().adapted("other", 1.0) == RankWeights()
