"""Splitting, provenance and documented functions."""

import datetime as dt
import random

import pytest

from lodeseam.llm.docpairs import description, file_pairs, is_trivial
from lodeseam.llm.provenance import file_provenance, provenance
from lodeseam.llm.queries import documented_functions
from lodeseam.llm.splitting import split_oversized, split_text

# ---- splitting


def test_split_round_trip():
    """Every line comes back: pieces without their overlaps give the text again."""
    rng = random.Random(5)
    for _ in range(200):
        lines = ["x" * rng.choice([0, 0, 3, 20, 60]) for _ in range(rng.randint(1, 60))]
        text = "\n".join(lines)
        pieces = split_text(text, 7, 120, 3)
        covered: dict[int, str] = {}
        for a, b, part in pieces:
            assert len(part) <= 120
            assert part == "\n".join(lines[a - 7 : b - 6])
            covered.update(zip(range(a, b + 1), part.split("\n")))
        assert all(not x or covered[k + 7] == x for k, x in enumerate(lines))


def test_split_places():
    text = "def a():\n" + "    x = 1\n" * 8 + "\n\ndef b():\n" + "    y = 2\n" * 8
    pieces = split_text(text, 1, 120, 0)
    assert pieces[0][2].endswith("x = 1") and pieces[1][2].lstrip().startswith("def b")
    assert [p[:2] for p in split_text("a\nb\nc\nd\ne\nf\ng\nh", 1, 9, 3)] == [(1, 5), (3, 7), (5, 8)]
    assert split_text("short", 4) == [(4, 4, "short")] and split_text("", 1) == [(1, 1, "")]
    assert [p[2] for p in split_text("aaaa bbbb cccc", 1, 9)] == ["aaaa ", "bbbb cccc"]
    assert [p[2] for p in split_text("z" * 25, 1, 10)] == ["z" * 10, "z" * 10, "z" * 5]
    assert split_text("\n" * 30, 1, 10) == []
    with pytest.raises(ValueError):
        split_text("x", 1, 0)


def test_split_frame(spark):
    t = dt.datetime(2024, 1, 1)
    ddl = "chunk_id string, project string, file_path string, start_line int, end_line int, content string, chunk_type string, language string, indexed_at timestamp, piece string, content_2 string"
    big = "é" * 1990 + "\n" + "tail of the text\n" * 200
    rows = [
        ("a", "p", "/a", 5, None, big, None, None, t, "x", None), ("a", "p", "/a", 5, None, big, None, None, None, "x", None), ("s", "p", "/s", 1, 1, "small", "f", "py", t, None, None),
        ("n", None, None, None, None, None, None, None, None, None, None), (None, "p", "/b", None, None, "w " * 1500, "block", "md", t, None, None), ("exact", "p", "/e", 1, 1, "é" * 2000, "block", "md", t, None, None),
    ]
    df = spark.createDataFrame(rows, ddl)
    got = split_oversized(df).collect()
    assert {r["chunk_id"] for r in got} == {"a", None}
    a = sorted((r for r in got if r["chunk_id"] == "a"), key=lambda r: r["piece"])
    assert a[0]["start_line"] == 5 and a[-1]["end_line"] == 5 + big.count("\n") and a[0]["pieces"] == len(a) and a[0]["chunk_type"] is None
    assert all(len(r["content"]) <= 2000 for r in got)
    assert split_oversized(df.limit(0)).count() == 0


# ---- provenance

HAND = "import os\n\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\n\nclass Reader:\n    def __init__(self, path):\n        self.path = path\n\n    def run(self):\n        for line in load(self.path).splitlines():\n            print(line)\n"


@pytest.mark.parametrize(
    "path,text,expected",
    [
        ("/r/src/a.py", HAND, None),
        ("/r/src/a.py", "# Code generated by protoc. DO NOT EDIT.\n" + HAND, "generated"),
        ("/r/src/a.py", "# do not edit the cursor while scanning\n" + HAND, None),
        ("/r/src/a.py", "# Reports on records that were generated by the nightly job; edit the limits below by hand.\n" + HAND, None),
        ("/r/src/a.py", HAND + "\nNOTICE = 'Code generated by x. DO NOT EDIT.'\n", None),
        ("/r/src/a.py", HAND + "\n# Auto-generated file. Do not modify.\n", "generated"),
        ("/r/src/a.js", "/*\n * @generated by tool\n */\nfoo();\n", "generated"),
        ("/r/third_party/x/a.py", HAND, "vendored"),
        ("/r/src/vendor_list/a.py", HAND, None),
        ("/r/src/a_pb2.py", HAND, "generated"),
        ("/r/src/a.min.js", "var a=1", "minified"),
        ("/r/src/a.js", "!function(a){b.c=1,d(a)}(e);f=g?h:i;" * 30, "minified"),
        ("/r/src/a.py", "T = [\n" + "".join(f"  [{k}, {k * 7}, 'x{k}'],\n" for k in range(40)) + "]\n", "data"),
        ("/r/src/a.py", "Q = 'select " + "a_column, " * 90 + "'\n" + HAND, None),
        ("/r/src/a.py", "# vivid v4.1.1\n# (c) the vivid contributors, MIT licence\n" + HAND, "vendored"),
        ("/r/src/a.py", "# Copyright the mine authors. All rights reserved.\n" + HAND, None),
        ("/r/src/a.py", "# Copyright the other authors. All rights reserved.\n" + HAND, "vendored"),
        ("/r/third_party/a.json", "{}", None),
        ("/r/yarn.lock", "x", "lockfile"),
        ("/r/src/a.py", "", None),
    ],
)
def test_provenance(path, text, expected):
    assert provenance(path, text, "mine") == expected
    assert provenance(path, text.replace("\n", "\r\n"), "mine") == expected


# ---- documented functions

PY = '@deco\nasync def load(path):\n    """Reads the whole file into memory.\n\n    :param path: where the file is\n    """\n    return 1\n\n\nclass A:\n    def get(self):\n        "Getter."\n\n    def set(self, v):\n        """Args:\n            v: the long value that is set here\n        """\n\n    def outer(self):\n        def inner():\n            """Counts what the outer one left."""\n'
JS = "/** Loads every user of one group. */\nexport async function loadUsers(g) { return '}' }\n\n// Walks the whole tree once.\n\nfunction gap() {}\n\n// const old = f(1);\n// return old;\nfunction code() {}\n\n/**\n * Sorts entries by their age.\n * @param {a} b the long parameter text here\n */\nconst sortThem = (a) => a;\n\nclass K {\n  // Gives back the cached value.\n  async cached() { return 1 }\n  /** TODO: write docs */\n  todo() {}\n  // eslint-disable-next-line no-console\n  log() {}\n}\n"
JAVA = "class A {\n  /** Merges both of the sorted lists. */\n  @Override\n  public List<Map<String, Integer>> mergeLists(int a, int b) throws E {\n    return null;\n  }\n\n  /* Opens a new file handle. */\n  A(int x) { }\n}\n"
GO = "package a\n\n// Run executes one statement on it.\nfunc (s *S) Run(q string) error {\n\treturn nil\n}\n\n//go:noinline\nfunc fast() {}\n"
RS = "/// Finds the next free slot quickly.\n#[inline]\npub(crate) fn find_slot(&self) -> u8 { 1 }\n"


def names(path, text):
    return [(p.symbol, p.decl_line) for p in file_pairs(path, text)]


def test_pairs_by_language():
    assert sorted(names("a.py", PY)) == [("inner", 20), ("load", 2)]
    assert names("a.js", JS) == [("loadUsers", 2), ("sortThem", 16), ("cached", 20)]
    assert names("a.java", JAVA) == [("mergeLists", 4), ("A", 9)]
    assert names("a.go", GO) == [("Run", 4)] and names("a.rs", RS) == [("find_slot", 3)]
    assert names("a.js", JS.replace("\n", "\r\n")) == names("a.js", JS)
    assert names("a.md", "# x") == [] and names("a.py", "") == [] and names("a", "x") == []
    pair = file_pairs("a.js", JS)[0]
    assert pair.docstring == "Loads every user of one group." and pair.content.endswith("return '}' }") and pair.end_line == 2


def test_descriptions():
    assert is_trivial("The load file function.", "load_file") and is_trivial("Docstring for loadFile", "loadFile") and is_trivial("", "x")
    assert not is_trivial("Reads every row again", "load")
    assert is_trivial("TODO: write docs", "x") and is_trivial("{@inheritDoc}", "x")
    assert description(["x = 1;", "return x;"]) == "" and description(["----", "@param x the y", "  goes on", "", "Says it all."]) == "Says it all."


def test_file_frames(spark):
    t = dt.datetime(2024, 1, 1)
    ddl = "chunk_id string, project string, file_path string, start_line int, end_line int, content string, indexed_at timestamp, symbol string, provenance string"
    rows = [("1", "p", "/a.js", 1, None, JS, t, None, None)] * 2 + [
        ("2", "p", "/vendor/b.js", 1, None, JS, t, None, None), ("3", "p", "/c.js", 1, None, JS + "}", t, None, None), ("4", None, "/d.py", 3, None, PY, None, None, None), ("5", "p", None, 1, None, JS, t, None, None), ("6", "p", "/e.go", None, None, None, t, None, None),
    ]
    df = spark.createDataFrame(rows, ddl)
    got = {(r["file_path"], r["symbol"], r["decl_line"]) for r in documented_functions(df).collect()}
    assert got == {("/a.js", "loadUsers", 2), ("/a.js", "sortThem", 16), ("/a.js", "cached", 20), ("/d.py", "load", 4), ("/d.py", "inner", 22)}
    assert {(r["file_path"], r["provenance"]) for r in file_provenance(df).collect()} == {("/a.js", None), ("/vendor/b.js", "vendored"), ("/c.js", None), ("/d.py", None), ("/e.go", None)}
    assert documented_functions(df.limit(0)).count() == 0 and file_provenance(df.limit(0)).count() == 0


def test_every_notice_and_banner_counts():
    """Banners and notices that hold none of the commoner phrases."""
    for line, want in (
        ("jquery v3.5.1", "vendored"), ("underscore.js 1.13.6 - utility belt", "vendored"), ("@license MIT", "vendored"), ("(c) 2019 the lodash contributors", "vendored"),
        ("Generated with openapi-generator", "generated"), ("This file was created by protoc", "generated"), ("Do not change this file", "generated"),
    ):
        assert provenance("/p/src/a.js", f"// {line}\nfunction f(a) {{\n  return a;\n}}\n", "p") == want, line


def test_blank_oversized_chunk_has_pieces(spark):
    ddl = "chunk_id string, project string, file_path string, start_line int, chunk_type string, language string, content string, indexed_at double"
    rows = [("spaces", "p", "a", 1, "block", "python", " " * 2001, 1.0), ("lines", "p", "a", 1, "block", "python", "\n" * 5000, 1.0), ("small", "p", "a", 1, "block", "python", "\n", 1.0)]
    got = split_oversized(spark.createDataFrame(rows, ddl)).collect()
    assert {r["chunk_id"] for r in got if r["piece"] == 0} == {"spaces", "lines"}
    assert all(len(r["content"]) <= 2000 for r in got)


PLAIN = {
    "constants.java": "package a;\n\npublic final class Limits {\n" + "".join(f"    public static final int LIMIT_{k} = {k * 7};\n" for k in range(16)) + "}\n",
    "init.py": "class Settings:\n    def __init__(self, source):\n" + "".join(f"        self.field_{k} = source.field_{k}\n" for k in range(16)),
    "iota.go": "package a\n\ntype Kind int\n\nconst (\n\tNone Kind = iota\n" + "".join(f"\tKind{k}\n" for k in range(20)) + ")\n",
    "index.ts": "".join(f"export {{ Part{k} }} from './part{k}';\n" for k in range(24)),
    "pages.js": "$(function () {\n" + "".join(f"  collapse('collapse-aggregated-{k}', 'aggregated-{k}');\n" for k in range(40)) + "});\n",
    "exports.py": "__all__ = [\n" + "".join(f"    'function_{k}',\n" for k in range(60)) + "]\nfrom .impl import *\n",
    "docs_gen.py": "def table(rows):\n    \"\"\"\n    Shows the rows.\n\n" + "".join(f"    {k} {k * 3} 'x{k}'\n" for k in range(60)) + "    \"\"\"\n    return rows\n",
    "routes.js": "".join(f"app.get('/r{k}', handlers.r{k});\n" for k in range(8)) + "export default app;\n",
    "codegen.py": "\"\"\"Writes the header 'Code generated by x. DO NOT EDIT.' to files.\"\"\"\n\ndef header(tool):\n    return f'# Code generated by {tool}. DO NOT EDIT.'\n",
}
THIRD_PARTY = (
    "/*! jQuery v3.6.0 | (c) OpenJS Foundation and other contributors | jquery.org/license */", "/*!\n * jQuery JavaScript Library v3.6.0\n * https://jquery.com/\n */", "/** @license React v17.0.2\n * react.development.js\n */",
    "/**\n * @license AngularJS v1.8.2\n * (c) 2010-2020 Google LLC. http://angularjs.org\n */", "/**\n * @license\n * Lodash <https://lodash.com/>\n */", "// lodash v4.17.21 - modern build", "//     Underscore.js 1.13.1\n//     https://underscorejs.org",
    "/*!\n  * Bootstrap v4.6.0 (https://getbootstrap.com/)\n  */", "/*!\n * Vue.js v2.6.14\n * (c) 2014-2021 Evan You\n */", "// https://d3js.org v7.0.0 Copyright 2010-2021 Mike Bostock\n// Copyright 2010-2021 and other contributors",
)
WRITTEN_BY_TOOLS = (
    "// Code generated by protoc-gen-go. DO NOT EDIT.", "# Generated by the protocol buffer compiler.  DO NOT EDIT!", "/**\n * Autogenerated by Thrift Compiler (0.13.0)\n */", "// Generated from Expr.g4 by ANTLR 4.9", "# Generated by Django 3.2 on 2021-05-01",
    "/* Generated By:JavaCC: Do not edit this line. */", "// This file is generated by jOOQ.", "/* automatically generated by rust-bindgen 0.59.1 */", "# This file is autogenerated by pip-compile", "// GENERATED CODE - DO NOT MODIFY BY HAND",
    "// NOTE: This class is auto generated by OpenAPI Generator", "/* AUTO-GENERATED FILE.  DO NOT MODIFY.\n */", "// <auto-generated/>", "/* A Bison parser, made by GNU Bison 3.0.4.  */", "# Form implementation generated from reading ui file 'a.ui'", "# WARNING! All changes made in this file will be lost!",
    "// This file was automatically generated and should not be edited.", "/* Generated by Cython 0.29.21 */", "// @generated SignedSource<<abc>>",
)


@pytest.mark.parametrize("name", PLAIN)
def test_ordinary_files_are_hand_written(name):
    assert provenance(f"/r/src/{name}", PLAIN[name], "r") is None


@pytest.mark.parametrize("header,verdict", [(h, "vendored") for h in THIRD_PARTY] + [(h, "generated") for h in WRITTEN_BY_TOOLS])
def test_public_headers(header, verdict):
    end = "py" if header.startswith("#") else "js"
    body = "def f(a):\n    return a + 1\n" if end == "py" else "function f(a) {\n  return a + 1;\n}\n"
    assert provenance(f"/r/src/a.{end}", header + "\n" + body, "r") == verdict
    assert provenance(f"/r/src/a.{end}", body, "r") is None


def test_every_rule_is_reached_through_its_anchors():
    """No rule can match a line that holds none of its anchors."""
    import re

    from lodeseam.llm.provenance import RULES

    lines = [x.strip("/*!# ") for h in (*THIRD_PARTY, *WRITTEN_BY_TOOLS) for x in h.split("\n")]
    for line in lines:
        for rule in RULES:
            if re.search(rule.line, line, re.I):
                assert any(a in line.lower() for a in rule.anchors), (line, rule)


@pytest.mark.parametrize(
    "name,text,symbol,first,last,content",
    [
        ("a.js", "// Checks the text for closing braces.\nfunction parse(s) {\n  return /[}]{2,}/.test(s);\n}\n\nfunction next() {}\n", "parse", 2, 4, "function parse(s) {\n  return /[}]{2,}/.test(s);\n}"),
        ("a.js", "// Shows three nested texts at once.\nconst f = (a) => `x ${a.map((b) => `y ${b ? `z ${`}`}` : '}'}`)}`;\ng();\n", "f", 2, 2, "const f = (a) => `x ${a.map((b) => `y ${b ? `z ${`}`}` : '}'}`)}`;"),
        ("a.ts", "class A {\n  /** Gives the longest of the names. */\n  @memo({ a: '}' })\n  async longest<T extends { a: string }>(x: T): Promise<{ b: T }> {\n    return { b: x } as const;\n  }\n}\n", "longest", 4, 6, "@memo({ a: '}' })\n  async longest<T extends { a: string }>(x: T): Promise<{ b: T }> {\n    return { b: x } as const;\n  }"),
        ("a.rs", "/// Gives back the raw closing text.\npub fn raw() -> &'static str {\n    r###\"} \"## }\"###\n}\n", "raw", 2, 4, "pub fn raw() -> &'static str {\n    r###\"} \"## }\"###\n}"),
        ("a.java", "class A {\n  // Joins both of the given halves.\n  @Ann(\"}\")\n  <T> String join(T a, T b) {\n    char c = '}';\n    return a + \"{\" + b;\n  }\n}\n", "join", 4, 7, "@Ann(\"}\")\n  <T> String join(T a, T b) {\n    char c = '}';\n    return a + \"{\" + b;\n  }"),
        ("a.go", "package a\n\n// Run starts every one of them.\nvar Run = func(xs []struct{ A int }) map[string]int {\n\treturn map[string]int{`}`: 1, \"{\": 2}\n}\n", "Run", 4, 6, "var Run = func(xs []struct{ A int }) map[string]int {\n\treturn map[string]int{`}`: 1, \"{\": 2}\n}"),
    ],
)
def test_functions_end_where_they_end(name, text, symbol, first, last, content):
    assert [(p.symbol, p.decl_line, p.end_line, p.content) for p in file_pairs(name, text)] == [(symbol, first, last, content)]


def test_prose_is_no_code():
    """Wrapped prose may begin with a word of a language or end in a semicolon."""
    assert description([" Use it when the input comes", " from an untrusted place and must be checked again."])
    assert description([" Called after each piece arrives;", " it moves the cursor forward and never blocks."])
    assert description(["let old = compute(limit, 3);", "return old;"]) == "" and description(["from a.b import c"]) == "" and description(["for x in rows:", "  go(x)"]) == ""


def test_files_that_do_not_parse_have_no_pairs():
    assert file_pairs("a.js", "// Says what it does.\nfunction f( {\n}\n") is None and file_pairs("a.py", "def f(:\n") is None
