"""Cutting files into chunks.

Python files follow the syntax tree; other languages are scanned for definitions whose braces are matched outside of
strings and comments; what lies between becomes blocks, and files without either are packed by lines.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodeseam.functions.text import IMPORTS, LANGUAGES
from lodeseam.schemas import CHUNK

MAX_CHUNK, OVERLAP_LINES, SLICE_LINES, MAX_SYMBOLS = 2000, 3, 200, 10

_MODIFIERS = r"(?:(?:export|default|public|private|protected|internal|fileprivate|open|static|final|abstract|async|synchronized|override|sealed|data|suspend|pub(?:\([^)]*\))?|unsafe|const|extern|@\w+(?:\([^)]*\))?)\s+)*"
#: One rule per kind of definition: its name is the group.
DEFINITIONS = {
    "class": rf"{_MODIFIERS}(?:class|struct|interface|trait|enum|protocol|object|extension|record)\s+(\w+)|impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)|type\s+(\w+)\s+(?:struct|interface)\b",
    "function": rf"{_MODIFIERS}(?:function\s*\*?\s*(\w+)|func\s+(?:\([^)]*\)\s*)?(\w+)|fn\s+(\w+)|fun\s+(\w+))|{_MODIFIERS}(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)",
    "method": rf"{_MODIFIERS}(?!(?:if|for|while|switch|catch|return|new|else|do|try|function|super|throw)\b)(?:[\w.<>\[\],?]+\s+)?(\w+)\s*\([^;{{}}]*\)\s*(?::\s*[\w<>\[\], |]+)?(?:throws\s+[\w, .]+)?\{{",
}
_START = {kind: re.compile(r"^[ \t]*(?:" + rule + ")", re.M) for kind, rule in DEFINITIONS.items()}
_NESTED_ONLY = {"method"}
_INERT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_CALL = re.compile(r"(?<![\w$])((?:[A-Za-z_$][\w$]*\s*(?:\.|::)\s*)*[A-Za-z_$][\w$]*)\s*\(")
_DEFINED = re.compile(r"\b(?:def|class|function|func|fn|fun)\b\s*\*?\s*(?:\([^)]*\)\s*)?\w*\s*\(?")
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "fun", "sizeof", "typeof", "super", "match", "and", "or", "not", "in"}


def language_name(path: str) -> str:
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return LANGUAGES.get(ext, ext)


def chunk_hash(path: str, start: int, content: str) -> str:
    return hashlib.md5(f"{path}:{start}:{content}".encode("utf-8", "replace")).hexdigest()[:12]


def pack_lines(lines: list[str], start: int, end: int) -> Iterator[tuple[int, int]]:
    """Line ranges (1-based) filled up to MAX_CHUNK characters, each repeating the last lines of the one before.

    Prefix sums give where each range must end, so a range costs one bisection; a line longer than the limit is alone.
    """
    sums = [0, *accumulate(len(x) + 1 for x in lines)]
    first = start
    fresh = start
    while fresh <= end:
        last = min(end, max(fresh, bisect_right(sums, sums[first - 1] + MAX_CHUNK) - 1))
        yield first, last
        fresh = last + 1
        kept = last - first + 1
        first = fresh - (OVERLAP_LINES if kept > OVERLAP_LINES else 0)


def _imports(language: str, text: str) -> list[str]:
    found: set[str] = set()
    for pattern in IMPORTS.get(language, ()):
        found.update(re.findall(pattern, text))
    return sorted(found)


def _calls(text: str) -> list[str]:
    """P10: what stands before an opening bracket."""
    return sorted({re.sub(r"\s", "", c) for c in _CALL.findall(_DEFINED.sub(" ", _INERT.sub('""', text))) if c not in _NO_CALL})


def _comment_above(lines: list[str], start: int) -> str:
    """The comment lines directly above a definition."""
    found = []
    k = start - 2
    while k >= 0 and lines[k].strip().startswith(("//", "#", "/*", "*")):
        found.append(lines[k].strip())
        k -= 1
    return " ".join(reversed(found))


def _python_spans(text: str) -> list[tuple[int, int, str, list[str], str, str, list[str]]] | None:
    """(first line, last line, type, symbols, parent, docstring, bases) of the top-level definitions and their methods."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def first_line(node) -> int:
        return min([node.lineno, *(d.lineno for d in node.decorator_list)])

    for node in tree.body:
        if isinstance(node, functions):
            out.append((first_line(node), node.end_lineno, "function", [node.name], "", ast.get_docstring(node) or "", []))
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, functions)]
            bases = sorted({ast.unparse(b) for b in node.bases})
            out.append((first_line(node), node.end_lineno, "class", [node.name, *(m.name for m in methods[:MAX_SYMBOLS])], "", ast.get_docstring(node) or "", bases))
            out.extend((first_line(m), m.end_lineno, "method", [m.name], node.name, ast.get_docstring(m) or "", []) for m in methods)
    return out


def _brace_spans(text: str, lines: list[str]) -> list[tuple[int, int, str, list[str], str, str, list[str]]]:
    """The same for languages with braces."""
    blank = _INERT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    close: dict[int, int] = {}
    depth_at: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", blank):
        if m.group() == "{":
            depth_at[m.start()] = len(stack)
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    opens = sorted(depth_at)
    found: dict[int, tuple[int, int, str, str, str]] = {}
    for kind, pattern in _START.items():
        for m in pattern.finditer(blank):
            name = next((g for g in m.groups() if g), None)
            at = bisect_right(opens, m.end() - 2 if kind == "method" else m.end() - 1)
            at = at - 1 if kind == "method" and at and opens[at - 1] == m.end() - 1 else at
            brace = m.end() - 1 if blank[m.end() - 1] == "{" else next((o for o in opens[at : at + 1] if ";" not in blank[m.end() : o] or kind == "class"), None)
            if name is None or brace is None or brace not in close:
                continue
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            line = bisect_right(starts, begin)
            found.setdefault(line, (line, bisect_right(starts, close[brace]), kind, name, blank[m.start() : brace]))
    classes = [v for v in found.values() if v[2] == "class"]
    out = []
    covered = 0
    for line, last, kind, name, head in sorted(found.values()):
        owner = next((c for c in classes if c[0] < line and last <= c[1] and c[0] != line), None)
        if kind == "method" and owner is None or line <= covered:
            continue
        if kind == "class":
            inside = [v[3] for v in sorted(found.values()) if v[2] != "class" and line < v[0] and v[1] <= last]
            bases = [b.strip() for b in re.split(r",", (re.search(r"(?:extends|implements|:)\s*([\w.,<>\s]+)$", head.strip()) or [None, ""])[1]) if b.strip()]
            out.append((line, last, "class", [name, *inside[:MAX_SYMBOLS]], "", _comment_above(lines, line), sorted(set(bases))))
        else:
            out.append((line, last, "method" if owner else "function", [name], owner[3] if owner else "", _comment_above(lines, line), []))
            covered = last  # nothing is looked for inside functions
    return out


def chunk_text(path: str, text: str, last_modified: float | None = None) -> list[tuple]:
    """Rows of the chunk schema for one file; none for a blank one."""
    text = (text or "").replace("\r\n", "\n")
    if not text.strip():
        return []
    language = language_name(path)
    lines = text.split("\n")
    spans = _python_spans(text) if language == "python" else _brace_spans(text, lines) if language in ("javascript", "typescript", "go", "java", "rust", "kotlin", "swift", "c", "cpp", "php") else []
    out: list[tuple] = []

    def add(first: int, last: int, kind: str, symbols: list[str], parent: str = "", doc: str = "", bases: list[str] = ()) -> None:
        content = "\n".join(lines[first - 1 : last])
        if not content.strip():
            return
        # An oversized unit goes in slices of lines
        size = SLICE_LINES if len(content) > MAX_CHUNK else last - first + 1
        for a in range(first, last + 1, size):
            b = min(last, a + size - 1)
            part = "\n".join(lines[a - 1 : b])
            if part.strip():
                out.append((chunk_hash(path, a, part), path, a, b, part, symbols, language, last_modified, parent, kind, doc, _imports(language, part), _calls(part), list(bases)))

    def add_lines(first: int, last: int, kind: str) -> None:
        if "".join(lines[first - 1 : last]).strip():
            for a, b in pack_lines(lines, first, last):
                add(a, b, kind, [])

    if not spans:
        add_lines(1, len(lines), "")
        return out
    cursor = 1
    for first, last, kind, symbols, parent, doc, bases in sorted(spans, key=lambda s: (s[0], -s[1])):
        if first > cursor:
            add_lines(cursor, first - 1, "block")
        add(first, last, kind, symbols, parent, doc, bases)
        cursor = max(cursor, last + 1)
    if cursor <= len(lines):
        add_lines(cursor, len(lines), "block")
    return out


def chunk_files(files: DataFrame, path: str = "file_path", text: str = "content", modified: str | None = None) -> DataFrame:
    """The chunks of every file; one Arrow pass, no shuffle. Null paths and blank texts give no rows."""
    struct = StructType.fromDDL(CHUNK)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for p, t, m in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out.extend(chunk_text(p, t, m))
                if len(out) > 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    when = F.col(modified).cast("double") if modified else F.lit(None).cast("double")
    return files.select(F.col(path).alias("p"), F.col(text).alias("t"), when.alias("m")).filter("p is not null").mapInArrow(run, struct)


_BLOCK = re.compile(r"(\s*)(async def|def|class)\s+(\w+)")


def block_bounds(lines: list[str], target: int) -> tuple[int, int, str, str] | None:
    """(first, last, type, name) of the Python-like definition around a line, or None."""
    if not 1 <= target <= len(lines):
        return None
    own = len(lines[target - 1]) - len(lines[target - 1].lstrip())
    for k in range(target - 1, -1, -1):
        m = _BLOCK.match(lines[k])
        if m and (len(m.group(1)) <= own or k == target - 1):
            break
    else:
        return None
    indent = len(m.group(1))
    last = len(lines)
    for j in range(target, len(lines)):
        bare = lines[j].strip()
        if bare and not bare.startswith("#") and len(lines[j]) - len(lines[j].lstrip()) <= indent:
            last = j
            break
    return k + 1, last, "class" if m.group(2) == "class" else "function", m.group(3)


def matches_to_hits(matches: DataFrame, files: DataFrame, path: str = "file_path", text: str = "content", half: int = 15) -> DataFrame:
    """P20: (file_path, line_no, start_line, end_line, preview, block_type, block_name): each match with the block around it.

    The matching lines of a file travel to its text as an array; a file without matches is not read into Python.
    """
    wanted = matches.groupBy("file_path").agg(F.sort_array(F.collect_set("line_no")).alias("hit_lines"))
    return line_blocks(files.select(F.col(path).alias("file_path"), F.col(text).alias("content")).join(wanted, "file_path"), half)


def line_blocks(files: DataFrame, half: int = 15, once: bool = False) -> DataFrame:
    """P20 over files that carry their matching lines as ``hit_lines``; ``once`` gives a block that holds several of them one row, that of the first."""
    schema = "file_path string, line_no int, start_line int, end_line int, preview string, block_type string, block_name string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, t, hits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines = (t or "").replace("\r\n", "\n").split("\n")
                seen = set()
                for n in hits:
                    found = block_bounds(lines, n)
                    first, last, kind, name = found or (max(1, n - half), min(len(lines), n + half), "file", None)
                    if once and (first, last) in seen:
                        continue
                    seen.add((first, last))
                    out.append((p, n, first, last, "\n".join(lines[first - 1 : last]), kind, name))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return files.select("file_path", "content", "hit_lines").mapInArrow(run, schema)
