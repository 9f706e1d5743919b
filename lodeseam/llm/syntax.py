"""Syntax checking of source files: one recogniser per language.

JavaScript, TypeScript, Java, Go and Rust have recursive-descent recognisers of their own (``grammars``), Python files go
through CPython's compiler and JSON through a strict decoder.  Syntax only: names and types are not looked at, nor errors
that depend on names (duplicate declarations, undefined labels, conflicting global statements).
"""

from __future__ import annotations

import ast
import json
import re
import warnings

from lodeseam.llm.grammars import go, java, rust, script

EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "rs": "rust", "json": "json", "md": "markdown"}

#: What CPython reports as a syntax error although only names are at fault.
_NAMES_AT_FAULT = re.compile(r"duplicate (?:argument|parameter)|nonlocal|\bglobal\b|assign to __debug__|is parameter and")
_last: list = ["", None]


def python_tree(text: str) -> ast.Module | None:
    """The syntax tree, or None; the last text's tree is kept for the operator that asks next."""
    if _last[0] != text or not text:
        _last[0], _last[1] = text, None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                _last[1] = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return _last[1]


def _python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file", "exec", dont_inherit=True)
        return True
    except SyntaxError as error:
        return bool(_NAMES_AT_FAULT.search(error.msg or "")) and python_tree(text) is not None
    except (ValueError, RecursionError, MemoryError):
        return False


def _no_constant(name: str):
    raise ValueError(name)


def _json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant)
        return True
    except (ValueError, RecursionError):
        return False


_PARSERS = {
    "python": _python, "json": _json, "javascript": script.parses, "typescript": lambda text: script.parses(text, True),
    "java": java.parses, "go": go.parses, "rust": rust.parses,
}


def language_of(path: str) -> str | None:
    """The language of a path's extension, or None for one that is not known here."""
    name = path.rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name else None


def parses(text: str, language: str | None, java_trailing_comma: bool = False) -> bool:
    """Whether the text is valid syntax. Unknown languages and Markdown always parse; so do empty files, save for JSON and Go.

    Code nested deeper than the interpreter's stack allows counts as not parsing, as it does for CPython's compiler.
    """
    if language in (None, "markdown"):
        return True
    text = text.replace("\r\n", "\n").lstrip("﻿")
    if language not in ("python", "json") and not text.strip():
        return language != "go"
    if language == "java":
        return java.parses(text, java_trailing_comma)
    return _PARSERS[language](text)
