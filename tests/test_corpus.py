import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseam.functions import text as tx
from lodeseam.functions import vectors as vx
from lodeseam.operators import incremental, search
from lodeseam.sources import corpus, state


@settings(max_examples=200, deadline=None)
@given(st.text("ab.*?[]!-/", max_size=8), st.text("ab.-/", max_size=8))
def test_globs_agree_with_fnmatch(glob, path):
    import re

    if "[" in glob and "-" in glob:
        return  # ranges that run backwards are read differently
    assert bool(re.fullmatch(corpus.glob_regex(glob), path, re.S)) == fnmatch.fnmatchcase(path, glob)


@pytest.mark.parametrize(
    "path,pattern,is_dir,expected",
    [
        ("src/build/a.py", "build/", False, True), ("build", "build/", True, True), ("build", "build/", False, False), ("a/b/c.log", "*.log", False, True), ("x/docs/a.md", "/docs/", False, False),
        ("docs/a.md", "/docs/", False, True), ("a/src/gen/x.ts", "src/gen/*", False, True), ("top.py", "/top.py", False, True), ("a/top.py", "/top.py", False, False), ("a/b.py", "  ", False, False),
        ("a/distx/b.py", "dist*/", False, True), ("a/dist/x/b.py", "dist?/", False, False),
    ],
)
def test_ignore_patterns(spark, path, pattern, is_dir, expected):
    got = spark.createDataFrame([(path,)], "p string").select(corpus.is_ignored(F.col("p"), [pattern], is_dir=is_dir)).first()[0]
    assert got is expected


def test_indexable(spark):
    paths = {"/r/a.py": True, "/r/node_modules/x.js": False, "/r/.git/a.py": False, "/r/package-lock.json": False, "/r/a.bin": False, "/r/t/a.md": True, None: None}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", corpus.is_indexable(F.col("p"), root="/r").alias("ok")).collect()
    assert all(bool(r["ok"]) == bool(paths[r["p"]]) for r in rows)
    assert corpus.ignore_patterns("# c\n\n a/ \n*.x") == ["a/", "*.x"]


def test_changes(spark):
    ddl = "path string, mtime double, size bigint, content_hash string"
    now = spark.createDataFrame([("same", 1.0, 1, "h"), ("mod", 2.0, 1, "h"), ("new", 1.0, 1, "h"), ("null", None, 1, None)], ddl)
    old = spark.createDataFrame([("same", 1.0, 1, "h"), ("mod", 1.0, 1, "h"), ("gone", 1.0, 1, "h"), ("null", None, 1, None)], ddl)
    assert {(r["path"], r["change"]) for r in incremental.changed_files(now, old).collect()} == {("mod", "modified"), ("new", "new"), ("gone", "deleted")}
    assert {r["change"] for r in incremental.changed_files(now, None).collect()} == {"new"}
    assert incremental.changed_files(now.limit(0), old.limit(0)).count() == 0


def test_lines_and_grep(spark):
    files = spark.createDataFrame([("a", "one\r\ntwo Load\nload"), ("b", None), ("c", ""), (None, "load")], "file_path string, content string")
    assert [(r["line_no"], r["line"]) for r in search.lines_of(files.filter("file_path = 'a'")).collect()] == [(1, "one"), (2, "two Load"), (3, "load")]
    assert search.grep(files, "load", fixed=True).count() == 2
    assert search.grep(files, "load", fixed=True, ignore_case=True).count() == 3
    assert search.grep(files, "^tw.*d$").count() == 1
    assert search.required_literal("load.*window") == "window" and search.required_literal("a|b") is None and search.required_literal("colou?r") == "colo"
    assert search.location_range("a.py:7-9") == ("a.py", 7, 9) and search.location_range("a.py:30") == ("a.py", 5, 55) and search.location_range("a.py") == ("a.py", 1, 50)


def test_literal_prefilter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", "x")], "file_path string, content string").write.parquet(str(tmp_path / "t"))
    plan = search.grep(spark.read.parquet(str(tmp_path / "t")), "load", fixed=True)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(content,load)" in plan


def test_vector_search(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [0.9, 0.1])], "id bigint, v array<double>")
    got = search.vector_search(rows.filter("id in (0, 5, 3)"), rows, 2, "id", "id", "v").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["row_id"]) for r in got] == [(0, 1), (0, 6)]
    assert search.vector_search(rows.limit(0), rows, 2, "id", "id", "v").count() == 0
    assert search.vector_search(rows, rows.limit(0), 2, "id", "id", "v").count() == 0


def test_score_functions(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert row.select(vx.cosine(F.col("a"), F.col("a")), vx.cosine(F.col("a"), F.col("b")), vx.distance_to_score(F.lit(0.5)), vx.distance_to_score(F.lit(4.0))).first()[:] == (1.0, 0.0, 0.75, 0.2)
    s = spark.createDataFrame([(0, 0.2), (0, 0.4), (0, 0.6), (1, 0.5), (2, None)], "q int, s double").withColumn("n", vx.min_max(F.col("s"), "q"))
    assert sorted((r["q"], round(r["n"], 6)) for r in s.filter("q < 2").collect()) == [(0, 0.0), (0, 0.5), (0, 1.0), (1, 0.5)]
    assert [r[0] for r in spark.createDataFrame([(0.1,), (0.5,), (1.0,)], "s double").select(vx.confidence_bounds(F.col("s"))).collect()] == [0.0, 0.5, 0.95]


def test_text_functions(spark):
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    assert first(tx.search_terms(F.lit("Where is the Größe of größe_x in it"))) == ["größe", "größe_x"]
    assert first(tx.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2 and first(tx.occurrences(F.lit("a"), F.lit(""))) == 0
    assert first(tx.quoted(F.lit("a \"b c\" 'd'"))) == ["b c", "d"] and first(tx.strip_quotes(F.lit("a 'b'"))) == "a b"
    assert first(tx.path_suffix(F.lit("/a/.env"))) == "" and first(tx.path_stem(F.lit("/a/b.tar.gz"))) == "b.tar" and first(tx.path_parent(F.lit("/a/b"))) == "/a"
    assert first(tx.language_for_path(F.lit("x/y.TSX"))) == "typescript" and first(tx.language_for_path(F.lit("x.zig"))) == "zig"
    assert first(tx.json_list(F.lit('["a","b"]'))) == ["a", "b"] and first(tx.json_list(F.lit("a,b"))) == ["a", "b"]
    assert first(tx.truncated(F.lit("x" * 100))) == "x" * 77 + "..."
    assert first(tx.recency(F.lit(0.0), F.lit(1.0))) == 0.0 and first(tx.recency(F.lit(100.0), F.lit(50.0))) == 1.0
    assert first(tx.imports(F.lit("python"), F.lit("import a.b\nfrom c import d"))) == ["a.b", "c"] and first(tx.imports(F.lit("ruby"), F.lit("x"))) == []
    assert first(tx.score_label(F.lit(0.6))) == "medium" and first(tx.speed_label(F.lit(100))) == "ok"


def test_embedding_cache(spark):
    ddl = "model string, text_hash string, embedding array<float>, created_at double"
    rows = spark.createDataFrame([("m", "a", [1.0, 0.0], 1.0), ("m", "a", [0.0, 1.0], 2.0), ("m", "b", [0.0, 0.0], 1.0), ("m", "c", [float("nan"), 1.0], 1.0), ("m", "d", None, 1.0), ("m", "e", [1.0], 1.0), ("x", "a", [1.0, 0.0], 1.0)], ddl)
    got = incremental.latest_embeddings(rows, {"m": 2}).collect()
    assert [(r["text_hash"], r["embedding"]) for r in got] == [("a", [0.0, 1.0])]
    hits, misses = incremental.cache_split(spark.createDataFrame([("m", "a"), ("m", "z")], "model string, text_hash string"), incremental.latest_embeddings(rows, {"m": 2}))
    assert hits.count() == 1 and [r["text_hash"] for r in misses.collect()] == ["z"]


def test_state(spark, tmp_path):
    assert state.load_json(tmp_path / "none.json", {"d": 1}) == {"d": 1}
    state.save_json(tmp_path / "x" / "a.json", [1])
    assert state.load_json(tmp_path / "x" / "a.json", None) == [1]
    (tmp_path / "log.json").write_text('{"query":"q","results":[],"selected_idx":null,"logged_at":1.0}\n\nbroken\n')
    assert [r["query"] for r in state.read_feedback(spark, str(tmp_path / "log.json")).collect()] == ["q"]
    assert state.render([]) == "No results."
    assert "a.py" in state.render([{"file_path": "a.py", "start_line": 1, "end_line": 2, "source": "grep", "score": 0.5, "preview": "x" * 90}])


def test_literal_prefilter_invents_nothing():
    for pattern in (r"\p{Alpha}+Error", r"\p{Upper}\w+", r"\p{Punct}{3}", r"\x41bcd", r"(abc){0,2}x", r"(foo(bar)baz)?x", r"a{100}", r"[\]abc]+x", r"xyz{2}{0}"):
        assert search.required_literal(pattern) is None, pattern
    assert search.required_literal(r"\s*foo") == "foo" and search.required_literal(r"foo\.bar+z") == "foo.bar" and search.required_literal(r"abcde{0,2}") == "abcd"


def test_content_hash_covers_the_whole_content(spark):
    rows = spark.createDataFrame([("a", "x" * 9000 + "1"), ("b", "x" * 9000 + "2")], "path string, content string")
    got = rows.select(*corpus.metadata(F.col("path"), F.col("content"), F.lit(1.0))).collect()
    assert len({r["content_hash"] for r in got}) == 2
