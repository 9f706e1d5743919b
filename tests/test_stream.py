import datetime as dt

from pyspark.sql import functions as F

from lodeseam.operators import feedback, graph
from lodeseam.plans.session_state import SessionState, UserProfile
from lodeseam.streaming.refresh import DirtySet, dirty_flushes, idle_sessions, refresh_index, threshold_flushes


def test_dirty_set():
    flushed = []
    d = DirtySet(flushed.append, limit=3, idle=2.0)
    d.mark("a", 0.0), d.mark("a", 0.5), d.mark("b", 1.0)
    assert not d.flush_if_idle(2.9) and d.flush_if_idle(3.1) and flushed == [["a", "b"]]
    assert not d.flush()
    for k in range(3):
        d.mark(str(k), 9.0)
    assert flushed[1] == ["0", "1", "2"]


def events(spark, rows):
    return spark.createDataFrame([(k, u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), p) for k, (u, s, p) in enumerate(rows)], "event_id int, user_id int, ts timestamp, props string")


def test_batch_twins(spark):
    rows = events(spark, [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (1, 10, "c"), (1, 11, "d"), (2, 0, "a")])
    got = sorted((r["user_id"], r["flush"], r["items"]) for r in threshold_flushes(rows, "user_id", "ts", "props", 2).collect())
    assert got == [(1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 1)]
    idle = sorted((r["user_id"], r["events"]) for r in feedback.idle_flushes(rows, "user_id", "ts", 2.0).collect())
    assert idle == [(1, 2), (1, 3), (2, 1)]
    assert threshold_flushes(rows.limit(0), "user_id", "ts", "props").count() == 0


def test_streamed_refresh(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a",), ("b",), ("a",)], "path string").write.json(str(src))
    seen = []
    q = refresh_index(spark.readStream.schema("path string").json(str(src)), lambda paths, n: seen.extend(sorted(r["path"] for r in paths.collect())), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == ["a", "b"]


def test_streamed_sessions(spark, tmp_path):
    rows = events(spark, [(1, 0, "a"), (1, 1, "b"), (1, 10, "c"), (2, 5000, "z")])
    rows.write.parquet(str(tmp_path / "in"))
    stream = idle_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "2 seconds", "1 seconds")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert sorted((r["user_id"], r["events"]) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2)]


def test_graph(spark):
    chunks = spark.createDataFrame(
        [("f.py", ["A"], "class", ["os"], ["g"], ["Base"]), ("f.py", [], None, None, ["h"], ["X"]), ("g.py", ["g"], "function", [], ["h"], []), (None, ["z"], "function", [], ["q"], [])],
        "file_path string, symbols array<string>, chunk_type string, imports array<string>, calls array<string>, inherits array<string>",
    )
    edges = graph.graph_edges(chunks)
    assert sorted((r["source"], r["target"], r["edge_type"]) for r in edges.collect()) == [("A", "Base", "inherits"), ("A", "g", "call"), ("f.py", "h", "call"), ("f.py", "os", "import"), ("g", "h", "call")]
    assert graph.graph_nodes(chunks).count() == 4
    wanted = spark.createDataFrame([("h",)], "symbol string")
    assert sorted(r["source"] for r in graph.callers_of(edges, wanted).collect()) == ["f.py", "g"]
    assert {(r["symbol"], r["depth"]) for r in graph.call_chain(edges, spark.createDataFrame([("A",)], "symbol string")).collect()} == {("A", 0), ("g", 1), ("h", 2)}
    assert graph.without_files(edges, spark.createDataFrame([("f.py",)], "file_path string"), "source_file").count() == 1


def test_feedback_frames(spark):
    one = "named_struct('file_path', '{0}.py', 'start_line', 1, 'end_line', 9, 'grep_score', 0.5D, 'semantic_score', cast(null as double), 'ast_score', 0D, 'symbol_boost', 0D, 'lexical_boost', 0D, 'recency_boost', 0D, 'language_boost', 0D, 'user_affinity_boost', 0D, 'context_boost', 0D, 'graph_boost', 0D)"
    rows = spark.sql(f"select * from values (1L, 'q', array({one.format('a')}, {one.format('b')}), 1, 1.0D), (1L, 'q', array({one.format('a')}, {one.format('b')}), 1, 1.0D), (2L, '', array(), null, 2.0D) as t(search_id, query, results, selected_idx, logged_at)")
    results = feedback.results_of(feedback.searches(rows))
    assert [(r["idx"], r["selected"], r["semantic_score"]) for r in results.orderBy("idx").collect()] == [(0, 0, 0.0), (1, 1, 0.0)]
    assert [(r["file_path"], r["affinity"]) for r in feedback.affinity(feedback.accesses(results)).collect()] == [("b.py", 1.0)]
    assert feedback.train_ltr(results) is None
    assert [r["language"] for r in feedback.preferred_languages(feedback.accesses(results)).collect()] == ["python"]
    assert [r["query"] for r in feedback.recent_queries(feedback.searches(rows)).collect()] == ["q"]
    reads = spark.createDataFrame([(7, "b.py", 5)], "read_id int, file_path string, line int")
    assert [(r["search_id"], r["idx"]) for r in feedback.attribute_reads(results, reads).collect()] == [(1, 1)]
    assert feedback.accesses(results.limit(0)).count() == 0 and F is not None


def test_streamed_dirty_sets(spark, tmp_path):
    rows = events(spark, [(1, k, f"f{k % 4}") for k in range(9)] + [(2, 0, "a"), (None, 0, "x")])
    rows.write.parquet(str(tmp_path / "in"))
    stream = dirty_flushes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user_id", "props", limit=3)
    q = stream.writeStream.format("memory").queryName("dirty").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = [(r["user_id"], len(r["items"]), r["reason"]) for r in spark.table("dirty").collect()]
    assert [g for g in got if g[2] == "limit"] and all(g[0] == 1 and g[1] == 3 for g in got if g[2] == "limit")


def test_session_and_profile(tmp_path):
    s = SessionState.load(tmp_path / "s.json")
    s.focus("a.py", 3), s.focus("b.py"), s.remember(7, "q", [{"file_path": "a.py", "start_line": 1, "end_line": 9}])
    s.save(tmp_path / "s.json")
    again = SessionState.load(tmp_path / "s.json")
    assert again == s and again.match_read("a.py", 9) == 0 and again.match_read("a.py", 10) is None
    again.close("b.py")
    assert again.open_files == ["a.py"] and again.current_file is None
    (tmp_path / "bad.json").write_text("[1")
    assert SessionState.load(tmp_path / "bad.json") == SessionState()
    p = UserProfile(most_queries=2)
    for x in ("a", "b", "a", " ", "c"):
        p.asked(x)
    p.opened("f"), p.opened("f"), p.opened("g")
    assert p.recent_queries == ["a", "c"] and p.affinities() == {"f": 2 / 3, "g": 1 / 3} and UserProfile().affinities() == {}


def test_watched_files(spark, tmp_path):
    """Files that were written since the last batch come once; a restarted query goes on where it was."""
    import os

    from lodeseam.streaming.refresh import watched_files

    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    for k, name in enumerate(("a.py", "sub/b.py")):
        (root / name).write_text("x")
        os.utime(root / name, (1000 + k, 1000 + k))
    seen = []

    def run():
        q = refresh_index(watched_files(spark, str(root)), lambda paths, n: seen.append(sorted(os.path.basename(r["path"]) for r in paths.collect())), str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    (root / "sub" / "b.py").write_text("y")
    os.utime(root / "sub" / "b.py", (2000, 2000))
    run()
    assert [x for x in seen if x] == [["a.py", "b.py"], ["b.py"]]
