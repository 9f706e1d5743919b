import pytest

from lodeseam.operators import chunking, structural
from lodeseam.operators.chunking import block_bounds, chunk_text, pack_lines

PY = 'import os\n\n@cached\ndef one(a):\n    """Doc."""\n    return two(a)\n\nclass A(Base):\n    def m(self):\n        return os.getcwd()\n\nx = 1\n'
TS = "import { a } from './b';\n\n/** Doc. */\nexport async function load(x: number) {\n  return fetch('}' + x);\n}\n\nclass B extends C {\n  get(id) {\n    if (id) { return 1; }\n  }\n}\n"


def spans(path, text):
    return [(r[2], r[3], r[9], r[5]) for r in chunk_text(path, text)]


def test_python_chunks():
    assert spans("a.py", PY) == [(1, 2, "block", []), (3, 6, "function", ["one"]), (8, 10, "class", ["A", "m"]), (9, 10, "method", ["m"]), (11, 13, "block", [])]
    row = chunk_text("a.py", PY)[1]
    assert row[10] == "Doc." and row[12] == ["two"] and chunk_text("a.py", PY)[2][13] == ["Base"] and chunk_text("a.py", PY)[3][8] == "A"


def test_brace_chunks():
    got = spans("a.ts", TS)
    assert (4, 6, "function", ["load"]) in got and (8, 12, "class", ["B", "get"]) in got and (9, 11, "method", ["get"]) in got
    assert chunk_text("a.ts", TS)[0][11] == ["./b"]
    assert next(r for r in chunk_text("a.ts", TS) if r[5] == ["load"])[10] == "/** Doc. */"
    assert (3, 5, "function", ["Run"]) in spans("q.go", "package a\n\nfunc (s *S) Run(q string) error {\n\treturn nil\n}\n")
    assert (1, 3, "function", ["f"]) in spans("q.rs", "pub fn f(x: u8) -> u8 {\n    x\n}\n")


def test_files_without_structure():
    assert chunk_text("a.md", "") == [] and chunk_text("a.md", None) == [] and chunk_text("a.py", "  \n") == []
    text = "\n".join(f"line {k} " + "x" * 90 for k in range(100))
    rows = chunk_text("a.txt", text)
    assert all(len(r[4]) <= 2000 for r in rows) and rows[1][2] == rows[0][3] - 2  # three lines repeat
    assert chunk_text("bad.py", "def (:\n")[0][9] == ""
    big = "def f():\n" + "".join(f"    x{k} = {k}\n" for k in range(450))
    assert [(r[2], r[3]) for r in chunk_text("b.py", big) if r[9] == "function"] == [(1, 200), (201, 400), (401, 451)]
    assert list(pack_lines(["x" * 5000, "y"], 1, 2)) == [(1, 1), (2, 2)]


def test_block_bounds():
    lines = "a = 1\nclass A:\n    def f(self):\n        return 1\n\n    # c\n\nb = 2".split("\n")
    assert block_bounds(lines, 4) == (3, 7, "function", "f") and block_bounds(lines, 1) is None and block_bounds(lines, 99) is None


def test_frames(spark):
    files = spark.createDataFrame([("a.py", PY, "python"), ("b.ts", TS, "typescript"), (None, "x", None), ("c.md", None, "markdown")], "file_path string, content string, language string")
    assert chunking.chunk_files(files).count() == len(chunk_text("a.py", PY)) + len(chunk_text("b.ts", TS))
    matches = spark.createDataFrame([("a.py", 6), ("a.py", 1)], "file_path string, line_no int")
    got = {r["line_no"]: r for r in chunking.matches_to_hits(matches, files).collect()}
    assert (got[6]["start_line"], got[6]["block_name"]) == (4, "one") and got[1]["block_type"] == "file"
    hits = structural.structural_search(files, ["fetch($X)"]).collect()
    assert [(h["file_path"], h["start_line"], h["ast_captures"]) for h in hits] == [("b.ts", 5, {"X": "'}' + x"})] or len(hits) <= 1


@pytest.mark.parametrize(
    "pattern,text,found",
    [
        ("f($X)", "f(1); f(g(2), 3); f()", ["f(1)"]),
        ("f($$$A)", "f(1); f(g(2), 3); f()", ["f(1)", "f(g(2), 3)", "f()"]),
        ("$X == $X", "a == a; a == b", ["a == a"]),
        ("if ($_) { $$$B }", "if (x) { y(); } // if (z) { }", ["if (x) { y(); }"]),
        ("log($M)", "log('f(1)') /* log(2) */", ["log('f(1)')"]),
        ("f(", "f(x", ["f("]),
    ],
)
def test_structural_patterns(pattern, text, found):
    assert [m[5] for m in structural.find_matches(text, [pattern], "javascript")] == found


def test_rules_rewrite_and_json(spark, tmp_path):
    assert structural.load_rule("swift-no-print") == ("swift", ["print($$$)"])
    (tmp_path / "r.yml").write_text("id: r\nlanguage: go\nrule:\n  any:\n    - pattern: a($X)\n    - pattern: b($X)\n")
    assert structural.load_rule("r", [tmp_path]) == ("go", ["a($X)", "b($X)"])
    with pytest.raises(ValueError):
        structural.load_rule("none")
    assert structural.rewrite("old(1, 2); x", "old($A, $B)", "new($B, $A)") == "new(2, 1); x"
    json = '[{"file":"a.py","text":"f(1)","language":"Python","range":{"start":{"line":5,"column":8},"end":{"line":5,"column":12}},"metaVariables":{"single":{"X":{"text":"1"}},"multi":{"Y":[{"text":"a"},{"text":"b"}]}}}]'
    rows = structural.parse_match_json(spark.createDataFrame([(json,), ("broken",), (None,)], "json string")).collect()
    assert len(rows) == 1 and rows[0]["start_line"] == 6 and rows[0]["ast_captures"] == {"X": "1", "Y": "a, b"}
