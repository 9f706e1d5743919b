"""Structural patterns over source code.

A pattern is a piece of code with metavariables: $NAME stands for one token or bracket group (equal names for equal
code), $_ for any one, $$NAME, $$$NAME and $$$ for any number.  Texts are compared token by token with brackets as units, so
white space, comments and line ends play no role.  This is weaker than a full grammar: operators are plain tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MATCH_SCORE = 0.9
_SKIPPED = r"\s+|//[^\n]*|/\*.*?\*/"
_PIECES = r"\${1,3}[A-Z_][A-Z0-9_]*|\${2,3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\w+|->|=>|::|:=|==|!=|<=|>=|&&|\|\||\+\+|--|.|\Z"
_TOKEN = re.compile(rf"(?:{_SKIPPED})*+({_PIECES})", re.S)
_HASH_TOKEN = re.compile(rf"(?:\s+|#[^\n]*)*+({_PIECES})", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def tokenise(text: str, language: str = "") -> list[tuple[str, int, int]]:
    """(token, start, end) without white space and comments."""
    pattern = _HASH_TOKEN if language in ("python", "ruby", "yaml") else _TOKEN
    return [(m[1], m.start(1), m.end()) for m in pattern.finditer(text) if m[1]]


def bracket_ends(tokens: list[tuple[str, int, int]]) -> list[int]:
    """For each opening bracket the position behind its partner; for others the next position; -1 where none closes."""
    ends = [k + 1 for k in range(len(tokens))]
    stack: list[int] = []
    for k, (t, _, _) in enumerate(tokens):
        if t in _PAIRS:
            ends[k] = -1
            stack.append(k)
        elif t in ")]}" and stack and _PAIRS[tokens[stack[-1]][0]] == t:
            ends[stack.pop()] = k + 1
    return ends


class Pattern:
    def __init__(self, text: str, language: str = ""):
        self.parts = [t for t, _, _ in tokenise(text, language)]
        self.first = next((p for p in self.parts[:1] if not p.startswith("$")), None)
        #: words that every match holds
        self.words = {p for p in self.parts if p[0].isalnum() or p[0] == "_"}

    def find(self, tokens: list[tuple[str, int, int]], ends: list[int]) -> Iterator[tuple[int, int, dict[str, tuple[int, int]]]]:
        """(first token, token behind the last, captures) of matches from left to right; they do not overlap."""
        k = 0
        while k < len(tokens):
            if self.first is None or tokens[k][0] == self.first:
                caught: dict[str, tuple[int, int]] = {}
                end = self._match(0, k, tokens, ends, caught, len(tokens))
                if end is not None and end > k:
                    yield k, end, caught
                    k = end
                    continue
            k += 1

    def _same(self, tokens, a: tuple[int, int], b: tuple[int, int]) -> bool:
        return [t for t, _, _ in tokens[a[0] : a[1]]] == [t for t, _, _ in tokens[b[0] : b[1]]]

    def _match(self, p: int, k: int, tokens, ends, caught, limit: int) -> int | None:
        if p == len(self.parts):
            return k
        part = self.parts[p]
        if not part.startswith("$"):
            return self._match(p + 1, k + 1, tokens, ends, caught, limit) if k < limit and tokens[k][0] == part else None
        name = part.lstrip("$")
        many = part.startswith("$$")
        if many:
            reach, at = [k], k
            while at < limit and 0 < ends[at] <= limit and tokens[at][0] not in (")", "]", "}"):
                at = ends[at]
                reach.append(at)
        else:
            reach = self._nodes(k, tokens, ends, limit)
        for end in reach:
            before = caught.get(name)
            if name not in ("", "_") and before is not None and not self._same(tokens, before, (k, end)):
                continue
            trial = dict(caught)
            if name not in ("", "_"):
                trial[name] = (k, end)
            got = self._match(p + 1, end, tokens, ends, trial, limit)
            if got is not None:
                caught.clear()
                caught.update(trial)
                return got
        return None

    @staticmethod
    def _nodes(at: int, tokens, ends, limit: int) -> list[int]:
        """Where one piece of code that starts here may end, the longest first: a token, a group, a name with members and calls."""
        if at >= limit or not 0 < ends[at] <= limit or tokens[at][0] in (")", "]", "}", ",", ";"):
            return []
        word = tokens[at][0][:1].isalnum() or tokens[at][0][:1] == "_"
        found = [ends[at]]
        at = ends[at]
        while word and at < limit:
            if tokens[at][0] in (".", "::") and at + 1 < limit:
                at += 2
            elif tokens[at][0] in ("(", "[") and 0 < ends[at] <= limit and tokens[at][1] == tokens[at - 1][2]:
                at = ends[at]
            else:
                break
            found.append(at)
        return found[::-1]


def find_matches(text: str, patterns: list[str], language: str = "") -> list[tuple[str, int, int, int, int, str, dict[str, str]]]:
    """(pattern, first line, first column, last line, last column, text, captures), 1-based lines, 0-based columns."""
    tokens = tokenise(text, language)
    ends = bracket_ends(tokens)
    breaks = [m.start() for m in re.finditer("\n", text)]
    there = {t for t, _, _ in tokens}
    out = []
    for source in patterns:
        pattern = Pattern(source, language)
        if not pattern.words <= there:
            continue
        for a, b, caught in pattern.find(tokens, ends):
            start, end = tokens[a][1], tokens[b - 1][2]
            first, last = bisect_left(breaks, start), bisect_left(breaks, end)
            captures = {n: text[tokens[i][1] : tokens[j - 1][2]] if j > i else "" for n, (i, j) in caught.items()}
            out.append((source, first + 1, start - (breaks[first - 1] + 1 if first else 0), last + 1, end - (breaks[last - 1] + 1 if last else 0), text[start:end], captures))
    return out


HITS = "file_path string, start_line int, end_line int, start_col int, end_col int, preview string, ast_pattern string, ast_rule string, ast_captures map<string,string>, ast_score double, source string, language string"


def structural_search(files: DataFrame, patterns: list[str], language: str | None = None, rule: str | None = None, max_matches: int | None = None) -> DataFrame:
    """The matches of all patterns in all files, as hits; no deduplication between patterns.

    Files have file_path, content and language. Those that hold none of the patterns' first words are dropped before
    Python sees them. A preview under 50 characters is widened to the lines around the match.
    """
    need = [max(re.findall(r"\w+", re.sub(r"\${1,3}\w+", " ", p)), key=len, default="") for p in patterns]
    source = files.filter("file_path is not null and content is not null")
    if language:
        source = source.filter(F.col("language") == language)
    if all(need):
        any_of = F.lit(False)
        for n in sorted(set(need)):
            any_of = any_of | F.contains("content", F.lit(n))
        source = source.filter(any_of)
    arrow = to_arrow_schema(StructType.fromDDL(HITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines = None
                for pattern, a, ca, b, cb, found, captures in find_matches(text, patterns, lang or ""):
                    if len(found) < 50:
                        lines = lines if lines is not None else text.split("\n")
                        found = "\n".join(x.rstrip() for x in lines[max(0, a - 2) : b + 1])
                    out.append((path, a, b, ca, cb, found, None if rule else pattern, rule, list(captures.items()), MATCH_SCORE, "ast", lang))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    hits = source.select("file_path", "content", "language").mapInArrow(run, HITS)
    return hits.orderBy("file_path", "start_line", "start_col", "ast_pattern").limit(max_matches) if max_matches else hits


# Rules that come with the package, as alternatives of patterns.
BUILTIN_RULES = {
    "swift-no-print": ("swift", ["print($$$)"]),
    "swift-try-catch": ("swift", ["do { $$$BODY } catch { $$$HANDLER }", "do { $$$BODY } catch $ERR { $$$HANDLER }"]),
    "swift-dispatchqueue-main-async": ("swift", ["DispatchQueue.main.async { $$$BODY }"]),
}


def load_rule(name: str, folders: list[Path] = ()) -> tuple[str | None, list[str]]:
    """(language, patterns) of a rule: a path, else the first folder that has it (.yml before .yaml), else a built-in one."""
    import yaml

    for path in [Path(name), *(Path(f) / f"{name}{s}" for f in folders for s in (".yml", ".yaml"))]:
        if path.suffix in (".yml", ".yaml") and path.is_file():
            data = yaml.safe_load(path.read_text())
            body = data.get("rule", {})
            return data.get("language"), [x["pattern"] for x in body["any"]] if "any" in body else [body["pattern"]]
    if name in BUILTIN_RULES:
        return BUILTIN_RULES[name]
    raise ValueError(f"no rule named {name}")


def list_rules(folders: list[Path] = ()) -> list[tuple[str, str]]:
    """(name, where it comes from) of all rules, by name; a folder's rule hides that of later folders and the built-in one."""
    found = {name: "built-in" for name in BUILTIN_RULES}
    for folder in reversed([Path(f) for f in folders]):
        for suffix in (".yaml", ".yml"):
            found.update({p.stem: str(p) for p in folder.glob(f"*{suffix}") if p.is_file()})
    return sorted(found.items())


AST_JSON = (
    "array<struct<file:string,text:string,lines:string,language:string,range:struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>,"
    "metaVariables:struct<single:map<string,struct<text:string>>,multi:map<string,array<struct<text:string>>>>>>"
)


def parse_match_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Hits from the JSON that structural search tools print; text that is no such JSON gives no rows."""
    m = F.col("m")
    single = F.transform(F.map_entries("m.metaVariables.single"), lambda e: F.struct(e["key"], e["value"]["text"]))
    multi = F.transform(F.map_entries("m.metaVariables.multi"), lambda e: F.struct(e["key"], F.array_join(F.transform(e["value"], lambda v: v["text"]), ", ")))
    none = F.expr("cast(map() as map<string,string>)")
    return texts.select(F.explode(F.from_json(column, AST_JSON)).alias("m")).select(
        m["file"].alias("file_path"),
        (m["range"]["start"]["line"] + 1).alias("start_line"),
        (m["range"]["end"]["line"] + 1).alias("end_line"),
        m["range"]["start"]["column"].alias("start_col"),
        m["range"]["end"]["column"].alias("end_col"),
        F.coalesce(m["text"], m["lines"]).alias("preview"),
        F.map_concat(F.coalesce(F.map_from_entries(single), none), F.coalesce(F.map_from_entries(multi), none)).alias("ast_captures"),
        F.lit(MATCH_SCORE).alias("ast_score"),
        F.lit("ast").alias("source"),
        F.lower(m["language"]).alias("language"),
    )


def rewrite(text: str, pattern: str, replacement: str, language: str = "") -> str:
    """The text with every match replaced; metavariables of the replacement get what the pattern caught."""
    tokens = tokenise(text, language)
    out, pos = [], 0
    for a, b, caught in Pattern(pattern, language).find(tokens, bracket_ends(tokens)):
        start, end = tokens[a][1], tokens[b - 1][2]
        values = {n: text[tokens[i][1] : tokens[j - 1][2]] if j > i else "" for n, (i, j) in caught.items()}
        out += [text[pos:start], re.sub(r"\${1,3}([A-Z_][A-Z0-9_]*)", lambda m: values.get(m.group(1), m.group()), replacement)]
        pos = end
    return "".join(out) + text[pos:]
