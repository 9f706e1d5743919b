"""End to end: index, incremental update, find, exact, read, context, ls, feedback."""

import os
import time

import pytest

from lodeseam.engine import Engine

SOURCES = {
    "auth/login.py": "import hashlib\n\n\nclass Session(Base):\n    def check_token(self, token):\n        '''Verify the login token of a user.'''\n        return hashlib.sha1(token)\n\n\ndef handle_login(user):\n    token = make_token(user)\n    return Session().check_token(token)\n",
    "auth/user.ts": "import { hash } from './hash';\n\nexport class UserStore extends Store {\n  load(id: number) {\n    console.log('load', id);\n    return this.items.get(id);\n  }\n}\n",
    "db/query.go": 'package db\n\nimport "fmt"\n\n// Run executes one statement.\nfunc Run(q string) error {\n\tfmt.Println(q)\n\treturn nil\n}\n',
    "vendor/skip.py": "def handle_login():\n    pass\n",
    "notes.md": "# Notes\n\nlogin happens before the session starts\n",
    "package-lock.json": "{}",
}


@pytest.fixture()
def engine(spark, tmp_path):
    for name, text in SOURCES.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return Engine(spark, str(tmp_path / "src"), str(tmp_path / "store"))


def test_index_and_update(engine):
    assert engine.status() == {"indexed": False, "reason": "not_indexed"}
    assert engine.index() == {"new": 4}
    assert engine.status()["files"] == 4
    assert engine.index() == {}
    path = os.path.join(engine.root, "db/query.go")
    with open(path, "a") as f:
        f.write("\nfunc Close() error {\n\treturn nil\n}\n")
    os.utime(path, (time.time() + 5, time.time() + 5))
    os.remove(os.path.join(engine.root, "notes.md"))
    assert engine.index() == {"modified": 1, "deleted": 1}
    rows = engine.table("chunks")
    assert rows.filter("array_contains(symbols, 'Close')").count() == 1
    assert rows.filter("file_path like '%notes.md'").count() == 0
    engine.clear()
    assert not engine.has_index()


def test_find_modes(engine):
    engine.index()
    exact = engine.find('"handle_login"').collect()
    assert exact and {r["source"] for r in exact} == {"grep"} and exact[0]["file_path"].endswith("login.py")
    hybrid = engine.find("where is the login token checked").collect()
    assert hybrid and any(r["semantic_score"] > 0 for r in hybrid) and [r["rank"] for r in hybrid] == list(range(1, len(hybrid) + 1))
    structural = engine.find("", ast_patterns=("console.log($$$)",)).collect()
    assert len(structural) == 1 and structural[0]["start_line"] == 5 and structural[0]["source"] == "ast"
    assert engine.find("nothing_like_this_anywhere", grep_only=True).collect() == []
    called = engine.find("token", callers="make_token").collect()
    assert called and all(r["file_path"].endswith("login.py") for r in called)


def test_reading(engine):
    assert [r["line_no"] for r in engine.exact("login", ignore_case=True).collect()]
    assert [r["line"] for r in engine.read("db/query.go:5-6").collect()] == ["// Run executes one statement.", "func Run(q string) error {"]
    block = engine.context("auth/login.py:12")
    assert (block["type"], block["name"], block["start_line"]) == ("function", "handle_login", 10)
    assert [(r["name"], r["is_dir"]) for r in engine.ls().collect()] == [("auth", True), ("db", True), ("notes.md", False)]


def test_feedback(engine):
    engine.index()
    hits = engine.find("login token").collect()
    assert len(hits) > 1
    for n in range(6):
        engine.log(n, "login token", hits, n % 2, float(n))
    weights = engine.train()
    assert weights and set(weights) >= {"intercept", "grep_score"} and engine.weights() == weights
    assert engine.find("login token", ltr=weights).count() == len(hits)


def test_follow(engine, spark, tmp_path):
    engine.index()
    assert engine.warm() == engine.table("chunks").count()
    path = os.path.join(engine.root, "db/query.go")
    with open(path, "a") as f:
        f.write("\nfunc Again() error {\n\treturn nil\n}\n")
    os.utime(path, (time.time() + 9, time.time() + 9))
    spark.createDataFrame([(path,)], "path string").write.json(str(tmp_path / "changes"))
    q = engine.follow(spark.readStream.schema("path string").json(str(tmp_path / "changes")), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert q.exception() is None and engine.table("chunks").filter("array_contains(symbols, 'Again')").count() == 1


def test_follow_reads_the_dirty_files_only(engine, spark, tmp_path):
    """A batch with one changed and one deleted file reads one file; the rest of the index stays as it was."""
    engine.index()
    before = {r["path"]: r["content_hash"] for r in engine.table("manifest").collect()}
    changed, gone = (os.path.join(engine.root, n) for n in ("db/query.go", "notes.md"))
    with open(changed, "a") as f:
        f.write("\nfunc Later() error {\n\treturn nil\n}\n")
    os.remove(gone)
    with open(os.path.join(engine.root, "auth/login.py"), "a") as f:
        f.write("\n\ndef unseen():\n    pass\n")
    read = []
    reindex = engine.reindex
    engine.reindex = lambda paths: read.append(reindex(paths))
    spark.createDataFrame([(changed,), (gone,), (changed,), (os.path.join(engine.root, "vendor/skip.py"),)], "path string").coalesce(1).write.json(str(tmp_path / "changes"))
    q = engine.follow(spark.readStream.schema("path string").json(str(tmp_path / "changes")), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert q.exception() is None and read == [1]
    rows = engine.table("chunks")
    assert rows.filter("array_contains(symbols, 'Later')").count() == 1 and rows.filter("array_contains(symbols, 'unseen')").count() == 0
    after = {r["path"]: r["content_hash"] for r in engine.table("manifest").collect()}
    assert set(after) == set(before) - {gone} and [p for p in after if after[p] != before[p]] == [changed]
    assert reindex([changed]) == 1 and engine.table("chunks").count() == rows.count()
    assert engine.index() == {"modified": 1} and engine.table("chunks").filter("array_contains(symbols, 'unseen')").count() == 1
    assert engine.ready() == (True, None)


def test_state_survives_replacement(spark, tmp_path):
    from lodeseam.sources.state import Folder

    folder = Folder(spark, str(tmp_path / "s"))
    assert folder.load("a.json", {"none": 1}) == {"none": 1}
    folder.save("a.json", {"x": "é"})
    folder.save("a.json", {"x": 2})
    assert folder.load("a.json", None) == {"x": 2} and folder.exists("a.json")
    (tmp_path / "s" / "b.json").write_text("{broken")
    assert folder.load("b.json", []) == []
