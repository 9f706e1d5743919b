import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseam.operators.diversity import Diversity, mmr_order, mmr_rerank
from lodeseam.operators.merge import merge_hits
from lodeseam.operators.ranking import cap_per_file, dedupe_previews, only_related, precise, rerank, score_hits
from lodeseam.schemas import HIT, as_hits

COLUMNS = "query_id bigint, source string, file_path string, start_line int, end_line int, preview string, symbols array<string>, grep_score double, semantic_score double, ast_score double, ast_captures map<string,string>, start_col int, language string, last_modified double"


def hit(source, path, a, b, score, preview="", symbols=(), captures=None, col=None, language=None, query=0):
    s = {"grep": 0.0, "semantic": 0.0, "ast": 0.0}
    if source:
        s[source] = score
    return (query, source, path, a, b, preview, list(symbols), s["grep"], s["semantic"], s["ast"], captures or {}, col, language, 0.0)


def frame(spark, *hits):
    return spark.createDataFrame(list(hits), COLUMNS)


def test_overlap_makes_a_hybrid(spark):
    m = merge_hits(frame(spark, hit("grep", "a.py", 10, 20, 1.0, "g", ["y"])), frame(spark, hit("semantic", "a.py", 18, 30, 0.7, "s", ["x", "y"], language="python"))).collect()
    assert len(m) == 1
    r = m[0]
    assert (r["source"], r["start_line"], r["end_line"], r["preview"], r["symbols"], r["language"]) == ("hybrid", 10, 30, "s", ["x", "y"], "python")


def test_merge_details(spark):
    m = merge_hits(
        frame(spark, hit("grep", "a", 1, 2, 0.5, "long grep text", ["b", "a"]), hit("grep", "b", 1, 2, 0.5, "x", ["b", "a"])),
        frame(spark),
        frame(spark, hit("ast", "a", 5, 5, 0.9, "ast", captures={"X": "1"}, col=4), hit("ast", "a", 6, 6, 0.9, "ast2", captures={"X": "2"}, col=7)),
    ).collect()
    by = {r["file_path"]: r for r in m}
    assert by["a"]["preview"] == "ast" and by["a"]["ast_captures"] == {"X": "2"} and by["a"]["start_col"] == 4 and by["a"]["source"] == "hybrid"
    assert by["b"]["symbols"] == ["b", "a"] and by["b"]["source"] == "grep"  # alone: untouched
    assert merge_hits(frame(spark), frame(spark)).count() == 0


def greedy(hits, within):
    out = []
    for a, b in sorted(hits):
        for k, (x, y) in enumerate(out):
            if not (y + within < a or b + within < x):
                out[k] = (min(x, a), max(y, b))
                break
        else:
            out.append((a, b))
    return sorted(out)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 12)), min_size=1, max_size=12), min_size=1, max_size=12))
def test_islands_equal_greedy_merge(spark, files):
    rows = [hit("grep", str(f), a, a + n, 0.5) for f, hits in enumerate(files) for a, n in hits]
    got: dict = {}
    for r in merge_hits(frame(spark, *rows)).collect():
        got.setdefault(r["file_path"], []).append((r["start_line"], r["end_line"]))
    for f, hits in enumerate(files):
        assert sorted(got[str(f)]) == greedy([(a, a + n) for a, n in hits], 3)


def test_scores(spark):
    rows = [hit("grep", "g", 1, 1, 0.5), hit("semantic", "s", 1, 1, 0.4), hit("ast", "a", 1, 1, 0.9), hit(None, "n", 1, 1, 0), hit("grep", "x", 1, 1, 7.0)]
    both = (0, "hybrid", "h", 1, 1, "", [], 0.5, 0.4, 0.0, {}, None, None, 0.0)
    full = (0, "hybrid", "f", 1, 1, "", [], 0.5, 0.4, 0.9, {}, None, None, 0.0)
    df = as_hits(frame(spark, *rows, both, full))
    got = {r["file_path"]: r["score"] for r in score_hits(df, F.lit(None).cast("string"), 0.0).collect()}
    assert got == pytest.approx({"g": 0.5, "s": 0.4, "a": 0.63, "n": 0.0, "x": 1.0, "h": 0.2 + 0.15 + 0.08, "f": 0.2 + 0.15 + 0.2})
    assert {r["file_path"]: r["score"] for r in score_hits(df, F.lit("x"), 0.0, ast_exhaustive=True).collect()}["a"] == pytest.approx(0.9)


def test_boosts(spark):
    row = (0, "grep", "src/a.py", 1, 1, "load the user table", ["UserTable"], 0.5, 0.0, 0.0, {}, None, "python", 100.0)
    r = score_hits(as_hits(frame(spark, row)), F.lit("user table python"), 100.0 + 30 * 86400, affinity=F.lit(0.5), context=F.lit(0.6), graph=F.lit(1.0)).first()
    assert r["symbol_boost"] == pytest.approx(0.08 * 2 / 3) and r["lexical_boost"] == pytest.approx(0.05 * 2 / 3)
    assert r["recency_boost"] == pytest.approx(0.015) and r["language_boost"] == pytest.approx(0.02)
    assert r["user_affinity_boost"] == pytest.approx(0.02) and r["context_boost"] == pytest.approx(0.03) and r["graph_boost"] == pytest.approx(0.04)
    blended = score_hits(as_hits(frame(spark, row)), F.lit(None).cast("string"), 0.0, ltr={"intercept": 0.0}).first()
    assert blended["score"] == pytest.approx(0.5 * (0.5 + 0.03) + 0.25)


def test_dedupe_cap_top(spark):
    rows = [hit("grep", "a", i, i, 0.9 - i / 100, f"p{i}") for i in range(5)] + [hit("grep", "b", 1, 1, 0.1, "p0 ")] + [hit("grep", "c", 1, 1, 0.05, "new\n text", query=1), hit("grep", "d", 1, 1, 0.04, "new text", query=1)]
    got = rerank(as_hits(frame(spark, *rows)), F.lit("q"), 0.0, k=10).collect()
    assert [(r["query_id"], r["file_path"], r["start_line"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(0, "a", 0), (0, "a", 1), (0, "a", 2), (1, "c", 1)]
    hits = score_hits(as_hits(frame(spark, *rows)), F.lit("q"), 0.0)
    assert cap_per_file(hits, 0).count() == len(rows)
    assert dedupe_previews(hits).count() == 6


def test_filters(spark):
    semantic, grep = hit("semantic", "s", 1, 1, 0.4, query=0), hit("grep", "g", 1, 1, 0.4, symbols=["T"], query=0)
    other = hit("semantic", "s", 1, 1, 0.4, query=1)
    assert {(r["query_id"], r["file_path"]) for r in precise(as_hits(frame(spark, semantic, grep, other))).collect()} == {(0, "g"), (1, "s")}
    related = spark.createDataFrame([("zzz", "T")], "file_path string, symbol string")
    assert [r["file_path"] for r in only_related(as_hits(frame(spark, semantic, grep)), related).collect()] == ["g"]
    assert only_related(as_hits(frame(spark, semantic, grep)), related.limit(0)).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10_000))
def test_mmr_is_a_permutation(n, seed):
    rng = np.random.default_rng(seed)
    scores, vectors = rng.random(n), rng.normal(size=(n, 3)) * (rng.random((n, 1)) > 0.1)
    order = mmr_order(scores, vectors, Diversity())
    assert sorted(order) == list(range(n)) and scores[order[0]] == scores.max()


def test_mmr_frame(spark):
    rows = as_hits(frame(spark, *[hit("grep", f"f{i}", 1, 1, 0.5, f"p{i}", query=i % 2) for i in range(6)])).withColumn("score", F.lit(0.5)).withColumn("vector", F.when(F.col("file_path") != "f3", F.array(F.lit(1.0), F.lit(0.0))))
    got = mmr_rerank(rows).collect()
    assert len(got) == 6 and sorted(r["mmr_rank"] for r in got if r["query_id"] == 0) == [1, 2, 3]


def test_hits_have_all_columns(spark):
    assert as_hits(spark.createDataFrame([("a",)], "file_path string")).columns == [x.split()[0] for x in HIT.split(", ")]


def test_embedding_reads_the_whole_text():
    from lodeseam.operators.embedding import hashing_embedder

    head = "alpha " * 2000
    short, long = hashing_embedder([head, head + "omega"])
    assert (short != long).any()


def test_precise_judges_each_query_by_itself(spark):
    from lodeseam.schemas import as_hits

    rows = [(1, "a", 0.5, 0.0), (1, "b", 0.0, 0.0), (2, "c", 0.0, 0.0), (2, "d", None, None), (3, "e", 0.0, 0.9), (None, "f", 0.0, 0.0)]
    hits = as_hits(spark.createDataFrame([(q, p, 1, 2, g, a) for q, p, g, a in rows], "query_id bigint, file_path string, start_line int, end_line int, grep_score double, ast_score double"))
    from lodeseam.operators import ranking

    assert sorted(r["file_path"] for r in ranking.precise(hits).collect()) == ["a", "c", "d", "e", "f"]


def test_hot_files_attribute_reads_by_bins(spark):
    from lodeseam.operators import feedback

    results = spark.createDataFrame([(1, 0, "a", 1, 500), (1, 1, "a", 60, 70), (2, 0, "a", 64, 64), (3, 0, "b", 1, 9), (4, 0, "a", None, None), (5, 0, "a", 9, 3)], "search_id bigint, idx int, file_path string, start_line int, end_line int")
    reads = spark.createDataFrame([(10, "a", 64), (11, "a", 63), (12, "a", 501), (13, None, 1), (14, "b", None)], "read_id int, file_path string, line int")
    got = {(r["read_id"], r["search_id"], r["idx"]) for r in feedback.attribute_reads(results, reads).collect()}
    assert got == {(10, 1, 0), (10, 2, 0), (11, 1, 0)}


def test_rules_are_listed_by_name(tmp_path):
    from lodeseam.operators.structural import list_rules

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "mine.yml").write_text("rule:\n  pattern: f($X)\n")
    (tmp_path / "b" / "mine.yaml").write_text("rule:\n  pattern: g($X)\n")
    (tmp_path / "b" / "swift-no-print.yml").write_text("rule:\n  pattern: h($X)\n")
    rules = dict(list_rules([tmp_path / "a", tmp_path / "b", tmp_path / "none"]))
    assert rules["mine"].endswith("a/mine.yml") and rules["swift-no-print"].endswith("swift-no-print.yml") and rules["swift-try-catch"] == "built-in"
