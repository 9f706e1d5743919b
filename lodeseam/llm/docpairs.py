"""Functions paired with their documentation (problem 4)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

from lodeseam.llm.grammars import go, java, rust, script
from lodeseam.llm.grammars.base import Function
from lodeseam.llm.syntax import language_of, parses, python_tree


class Pair(NamedTuple):
    symbol: str
    decl_line: int
    end_line: int
    docstring: str
    content: str


# --------------------------------------------------------------------------- what a description says

_PLACEHOLDER = re.compile(r"\b(?:todo|tbd|fixme|xxx|n/a|lorem ipsum|write (?:docs?|me|documentation)|documentation (?:pending|missing)|add (?:docs?|description|documentation)(?: here)?|fill (?:me )?in|see (?:above|below)|to be (?:done|defined|written))\b[:.]*", re.I)
_MARKER = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd)\b", re.I)
_TAG_LINE = re.compile(r"^\s*(?:[@\\][A-Za-z]\w*|:(?:param|parameter|arg|argument|key|keyword|type|rtype|returns?|raises?|except|exception|var|ivar|cvar|meta)\b[^:]*:)")
_SECTION = re.compile(r"^\s*(?:#+\s*)?(?:args|arguments|params?|parameters|returns?|yields?|raises|throws|attributes|errors|panics|safety|keyword args|keyword arguments|other parameters|see also|examples?)\s*:?\s*$", re.I)
_RULE = re.compile(r"^\s*[-=~*#_/]{3,}\s*$")
_INLINE_TAG = re.compile(r"\{@\w+[^}]*\}|</?\w+[^>]*>|https?://\S+")
_PARAM_ITEM = re.compile(r"^\s*[*-]?\s*`?[\w.$]+`?\s*(?:\([^)]*\))?\s*(?::|--?|–)\s")
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8|@ts-|@flow|@jsx|noqa|nosec|pylint|flake8|mypy|pyright|ruff|isort|type:\s*ignore|fmt:|yapf|pragma|coding[:=]|-\*-|go:\w|nolint|\+build|"
    r"lint:|rustfmt|clippy|nosonar|checkstyle|sonar|spotless|noinspection|@formatter|clang-format|cspell|spell-?checker|codecov|region\b|endregion\b|sourcemappingurl|<reference\b|!/)",
    re.I,
)
_CODE_LINE = re.compile(
    r"\{\s*$|^\s*[\]})]+[;,)]*\s*$|^\s*(?:return\b(?:\s+[\w.\[\]()\"']+)?|break|continue|pass)\s*;?\s*$"
    r"|^\s*(?:const|let|var|val|def|fn|func|function|class|struct|impl|package|use|import|public|private)\s+[\w.:*{}$]+\s*(?:[=({:;<]|$)|^\s*(?:from\s+[\w.]+\s+import\b|import\b.*\bfrom\s+[\"'])"
    r"|^\s*(?:try|else|finally)\s*:\s*$|^\s*(?:if|elif|while|with|match|switch)\b(?=.*[()=<>\[\]._]).*:\s*$|^\s*for\s+[\w, ]+\bin\b\s+[\w.()\[\], ]+:\s*$"
    r"|^\s*[\w.\[\]\"'$]+(?:\s*,\s*[\w.\[\]]+)*\s*(?::=|[-+*/|&%^]?=)(?!=)\s*\S|^\s*[\w.$]+\([^)]*\)\s*;?\s*$"
)
#: A line that ends in a semicolon is code if it holds one of these or is short; prose may end a line that way too.
_CODE_MARK = re.compile(r"[=()\[\]{}<>]|::|\w\.\w")
_LEGAL = re.compile(r"^\W*(?:copyright\b|\(c\)|spdx-|licen[sc]ed under|see the licen[sc]e)", re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+|[^\W\d_]+")


def _parts(word: str) -> list[str]:
    return [p.lower() for p in _CAMEL.findall(word)]


def description(lines: list[str], python: bool = False) -> str:
    """The prose of a documentation comment: without tags, parameter lists, directives, rules and commented-out code."""
    kept: list[str] = []
    skipping, skip_indent = "", 0
    for raw in lines:
        bare = raw.strip()
        if not bare:
            if skipping == "tag":
                skipping = ""
            kept.append("")
            continue
        if _SECTION.match(raw):
            skipping, skip_indent = "section", len(raw) - len(raw.lstrip())
            continue
        if _TAG_LINE.match(raw):
            skipping = "tag"
            continue
        if skipping == "tag":
            continue
        if skipping == "section":
            indent = len(raw) - len(raw.lstrip())
            if indent > skip_indent or _RULE.match(raw) or _PARAM_ITEM.match(raw):
                continue
            skipping = ""
        if _RULE.match(raw) or _DIRECTIVE.match(bare) or _MARKER.match(bare) or _LEGAL.match(bare):
            continue
        kept.append(bare)
    code = sum(1 for x in kept if x and _is_code(x))
    if code and 2 * code >= sum(1 for x in kept if x):
        return ""
    return "\n".join(kept).strip()


def _is_code(line: str) -> bool:
    if line.rstrip().endswith(";") and (_CODE_MARK.search(line) or len(line.split()) <= 2):
        return True
    return _CODE_LINE.search(line) is not None


def is_trivial(text: str, symbol: str) -> bool:
    """Fewer than four different words that the name does not contain."""
    text = _PLACEHOLDER.sub(" ", _INLINE_TAG.sub(" ", text))
    own = set(_parts(symbol)) | {symbol.lower()}
    said: set[str] = set()
    for m in re.finditer(r"[^\W\d]\w*(?:['’][^\W\d_]+)*", text):
        word = m.group()
        if word.lower() in own:
            continue
        pieces = _parts(word) if ("_" in word or not (word.islower() or word.isupper() or word.istitle())) else [word.lower()]
        said.update(p for p in pieces if p not in own)
        if len(said) >= 4:
            return False
    return True


# --------------------------------------------------------------------------- Python


def _python_pairs(text: str) -> Iterator[tuple[str, int, int, str]]:
    tree = python_tree(text)
    if tree is None:
        return
    stack: list = [tree.body]
    while stack:
        for node in stack.pop():
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = node.body[0]
                if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                    yield node.name, node.lineno, node.end_lineno, first.value.value
                stack.append(node.body)
            else:
                for field in ("body", "orelse", "finalbody"):
                    inner = getattr(node, field, None)
                    if isinstance(inner, list):
                        stack.append(inner)
                for field in ("handlers", "cases"):
                    for h in getattr(node, field, ()):
                        stack.append(h.body)


# --------------------------------------------------------------------------- languages with braces

_FUNCTIONS = {
    "javascript": script.functions, "typescript": lambda text: script.functions(text, True), "go": go.functions, "rust": rust.functions,
    "java": java.functions,
}


def _comment_lines(text: str) -> list[str]:
    if text.startswith("//"):
        return [re.sub(r"^\s*//+!?", "", x) for x in text.split("\n")]
    body = text[2:-2] if text.endswith("*/") else text[2:]
    return [re.sub(r"^\s*\*+(?!/)", "", x) if k else x.lstrip("*!") for k, x in enumerate(body.split("\n"))]


def _skip(text: str, pos: int) -> int:
    while pos < len(text) and text[pos] in " \t":
        pos += 1
    return pos


def _units(text: str, comments: list[tuple[int, int]]) -> list[list[int]]:
    """[start, end, is block] of the comments that stand alone on their lines; line comments on lines in a row are one."""
    units: list[list[int]] = []
    for s, e in comments:
        before, after = s - 1, _skip(text, e)
        while before >= 0 and text[before] in " \t":
            before -= 1
        if before >= 0 and text[before] != "\n" or after < len(text) and text[after] != "\n":
            continue
        block = text[s + 1] == "*"
        if units and not block and not units[-1][2] and text[units[-1][1] : s].count("\n") == 1 and not text[units[-1][1] : s].strip():
            units[-1][1] = e
        else:
            units.append([s, e, block])
    return units


def _documents(text: str, units: list[list[int]], u: int) -> list[str]:
    """The lines of a comment; where they are directives to tools, of the one directly above it."""
    lines = _comment_lines(text[units[u][0] : units[u][1]])
    while u and all(not x.strip() or _DIRECTIVE.match(x.strip()) for x in lines):
        gap = text[units[u - 1][1] : units[u][0]]
        if gap.strip() or gap.count("\n") != 1:
            break
        u -= 1
        lines = _comment_lines(text[units[u][0] : units[u][1]])
    return lines


def _brace_pairs(text: str, found: list[Function], comments: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, str, int]]:
    """(name, its offset, end, description, start) of the functions directly below a comment that says something.

    Annotations and attributes may stand between; of a comment above them and one below, the nearer that is not trivial
    counts.
    """
    units = _units(text, comments)
    above = {}
    for u, (_, e, _) in enumerate(units):
        e = _skip(text, e)
        if text[e : e + 1] == "\n":
            above[_skip(text, e + 1)] = u
    for name, at, end, heads in found:
        for head in reversed(heads):
            if head in above:
                clean = description(_documents(text, units, above[head]))
                if clean and not is_trivial(clean, name):
                    yield name, at, end, clean, heads[0]
                    break


def pairs(text: str, language: str | None, java_trailing_comma: bool = False) -> list[Pair] | None:
    """The documented functions of one file; descriptions that say nothing are dropped. None where the file does not parse."""
    text = text.replace("\r\n", "\n").lstrip("\ufeff")
    out: list[Pair] = []
    if language == "python":
        if not parses(text, language):
            return None
        lines = None
        for name, first, last, doc in _python_pairs(text):
            clean = description(doc.expandtabs().split("\n"), True)
            if clean and not is_trivial(clean, name):
                lines = lines or text.split("\n")
                out.append(Pair(name, first, last, clean, "\n".join(lines[first - 1 : last])))
    elif language in _FUNCTIONS and text.strip():
        known = java.functions(text, java_trailing_comma) if language == "java" else _FUNCTIONS[language](text)
        if known is None:
            return None
        line, counted = 1, 0
        for name, at, end, clean, start in _brace_pairs(text, known[0], known[1].comments):
            line += text.count("\n", counted, at)
            counted = at
            out.append(Pair(name, line, line + text.count("\n", at, end), clean, text[start:end]))
    elif not parses(text, language):
        return None
    return out


def file_pairs(path: str, text: str, java_trailing_comma: bool = False) -> list[Pair] | None:
    return pairs(text, language_of(path), java_trailing_comma)
