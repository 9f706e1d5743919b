"""Generated, minified, vendored and data files (problem 2)."""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from lodeseam.sources.assembly import map_files


class Rule(NamedTuple):
    """A comment line that matches ``line`` gives the verdict; each match holds one of the ``anchors``, which the automaton looks for."""

    verdict: str
    anchors: tuple[str, ...]
    line: str


# What comment lines of generated files, and banners of third-party copies, say.
RULES = (
    Rule("generated", ("<auto-generated", "<autogenerated"), r"<auto-?generated\b"),
    Rule("generated", ("@generated",), r"@generated\b"),
    Rule("generated", ("auto-generated", "autogenerated", "auto generated"), r"\bauto[- ]?generated\b(?! (?:ids?|keys?|names?|values?|columns?)\b)"),
    Rule("generated", ("machine generated", "machine-generated", "machine written", "machine-written"), r"\bmachine[- ](?:written|generated)\b"),
    Rule("generated", ("code generated", "generated code"), r"\bcode generated\b(?=.*(?:by\b|from\b|do not edit))|\bgenerated code\b\W*(?:$|do(?: not|n't)\b)"),
    Rule("generated", ("automatically generated", "automatically created", "automatically produced", "automatically @generated"), r"\bautomatically @?(?:generated|created|produced)\b"),
    Rule("generated", ("generated", "created", "produced"), r"\b(?:this|the) (?:file|class|code|module|source(?: code)?) (?:is|was|has been) (?:\w+ )?(?:generated|created|produced) (?:by|from|with)\b"),
    Rule("generated", ("generated by", "generated from", "generated with"), r"^\W*(?:(?:file|source|code|classes|bindings|parser|lexer) )?generated (?:by\b|from\b|with\b)"),
    Rule("generated", ("this is a generated", "this file is generated", "this file was generated"), r"\bthis (?:is a generated (?:file|class)\b|file (?:is|was) generated\b)"),
    Rule("generated", ("do not edit", "don't edit", "do not modify", "don't modify", "do not change", "don't change"), r"\bdo(?: not|n't) (?:edit|modify|change)(?= *(?:[.!,;:*/-]|$)| (?:this|the (?:file|class)|it|by hand|manually|directly|here|unless you are sure))"),
    Rule("generated", ("changes", "edits", "modifications"), r"\b(?:manual )?(?:changes|edits|modifications)\b.*\b(?:will be|are) (?:lost|overwritten)\b"),
    Rule("generated", ("regenerate",), r"\bregenerate\b.*\binstead of\b"),
    Rule("generated", ("from template", "from the template"), r"\bbuilt from (?:the )?template\b"),
    Rule("generated", ("produced by",), r"^\W*produced by\b.*\bfrom\b"),
    Rule("generated", ("emitter:",), r"\bsource: \S+.*\bemitter:"),
    Rule("generated", ("made by gnu bison", "scanner generated by", "ui code generator", "from reading ui file", "from reading c++ file"), r"\bmade by gnu bison\b|\bscanner generated by\b|\bui code generator\b|\bfrom reading (?:ui|c\+\+) file\b"),
    Rule("generated", ("maschinell",), r"\bmaschinell\b.*\b(?:erzeugt|generiert|erstellt)\b"),
    Rule("generated", ("automatisch",), r"\bautomatisch (?:erzeugt|generiert|erstellt)\b"),
    Rule("generated", ("nicht bearbeiten", "nicht ändern"), r"\bnicht (?:bearbeiten|ändern)\b *(?:[.!]|$)"),
    Rule("generated", ("produit par", "généré par", "généré automatiquement"), r"\b(?:produit|généré) par\b|\bgénéré automatiquement\b"),
    Rule("generated", ("ne pas modifier", "ne pas éditer"), r"\bne pas (?:modifier|éditer)\b *(?:[.!*]|$)"),
    Rule("generated", ("generado por", "generado automáticamente"), r"\bgenerado (?:por|automáticamente)\b"),
    Rule("generated", ("no editar", "no modificar"), r"\bno (?:editar|modificar)\b *(?:[.!*]|$)"),
    Rule("vendored", ("maintained upstream",), r"\bmaintained upstream\b"),
    Rule("vendored", ("imported from", "vendored from", "copied from"), r"\b(?:imported|vendored|copied) from (?:the )?[\w.-]+ (?:at (?:tag|commit|version|rev)|v?\d)"),
    Rule("vendored", ("(c)", "©"), r"(?:\(c\)|©) (?:\d+[-, ]*)*(?:the )?[\w. -]+ contributors"),
    Rule("vendored", ("contributors",), r"^\W*copyright\b.* and other contributors\b"),
    Rule("vendored", ("upstream:",), r"^\W*upstream: \S+"),
    Rule("vendored", ("@license", "@licence"), r"^\W*@licen[sc]e\b"),
    Rule("vendored", tuple(f".{d}" for d in range(10)), r"^\W*[\w.-]+ v?\d+(?:\.\d+)+ - \w|^\W*[\w.-]+(?: javascript library)? v\d+\.\d+(?:\.\d+)?(?:[-.]\w+)*(?:\W*$|\W* \(?(?:\||\(?https?:|copyright\b|\(c\)))|^\W*[\w-]+\.js v?\d+\.\d+(?:\.\d+)?\W*$"),
)
_RULES = [(r.verdict, re.compile(r.line, re.I)) for r in RULES]
#: Quoted words are mentioned, not said.
QUOTED = re.compile(r"(?<!\w)(?:'[^']+'|\"[^\"]+\"|`[^`]+`)(?!\w)")
OWNER = re.compile(r"copyright (?:\(c\) )?(?:\d{4}[-, \d]* )?the ([\w.-]+) authors", re.I)
# Directories for copies of other projects, and for what tools write.
VENDORED = re.compile(
    r"/(?:vendor|vendors|_vendor|vendored|_vendored|third[-_]?party|3rd[-_]?party|thirdparty|extern|externals|deps|contrib|node_modules|bower_components|site-packages|godeps|pods|carthage|jspm_packages|packages/bundled|bundled|static/lib|static/libs)/",
    re.I,
)
GENERATED_PATH = re.compile(r"/(?:generated|__generated__|autogen|auto_generated|gen|codegen_out|generated-sources)/|(?:_pb2(?:_grpc)?|\.pb|\.pb\.gw|\.g|\.gen|\.generated|\.designer|_generated)\.\w+$", re.I)
MINIFIED_PATH = re.compile(r"(?:[.-]min|\.bundle|\.chunk|\.packed|-[0-9a-f]{6,32})\.(?:js|ts|css|mjs|cjs)$", re.I)
LOCKFILE = re.compile(r"/(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock)$", re.I)
NOT_CODE = re.compile(r"\.(?:json|md|markdown)$", re.I)
COMMENT = re.compile(r"^\s*(?:#!?|//+!?|/\*+!?|\*+/?|<!--|\"\"\"|'''|--|;)\s?(.*?)\s*(?:\*+/|-->)?\s*$")
LITERALS = re.compile(rb'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?)\w*')
_DOCSTRING = re.compile(rb"^[ \t]*[rRuU]?(\"\"\"|''').*?\1[ \t]*$|^__all__ = [\[(][^\])]*[\])]", re.M | re.S)
_CALL_LINE = re.compile(rb"^[ \t]*[\w.$]+\([^\n]*\);?[ \t]*$", re.M)
_HASH_COMMENT, _SLASH_COMMENT = re.compile(rb"^[ \t]*#[^\n]*$", re.M), re.compile(rb"/\*.*?\*/|^[ \t]*//[^\n]*$", re.M | re.S)

#: Share of a file's code that literals make up from which it is data, and the literals it then has at least.
DATA_SHARE, DATA_LITERALS = 0.5, 16
#: Bytes a code line has on average, and share of white space, from which code is minified.
MINIFIED_LINE, MINIFIED_SPACE = 160, 0.07
#: Lines at the top and at the end of a file in which notices are looked for, besides the whole leading comment.
HEAD_LINES, FOOT_LINES = 12, 4


def _comments(lines: list[str], python: bool) -> list[str]:
    """Texts of the comment lines at the top (the whole leading comment, and as far as HEAD_LINES) and at the end."""
    found, leading = [], True
    for k, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        m = COMMENT.match(line) if not (python and bare[0] in "/*;-") and not (not python and bare[0] in "#;\"'-") else None
        if m:
            found.append(m.group(1))
        elif leading and found and bare[0].isalpha() and found[-1:] and not re.search(r"[=(){};]", bare):
            found.append(bare)  # text within a block comment without asterisks
        else:
            leading = False
        if not leading and k >= HEAD_LINES:
            break
    for line in lines[-FOOT_LINES:]:
        m = COMMENT.match(line) if line.strip() and line.strip()[0] in ("#" if python else "/*") else None
        if m:
            found.append(m.group(1))
    return found


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    rules: dict[str, list[int]] = {"copyright": [-1]}
    for number, rule in enumerate(RULES):
        for anchor in rule.anchors:
            rules.setdefault(anchor, []).append(number)
    for anchor, numbers in rules.items():
        found.add_word(anchor, tuple(numbers))
    found.make_automaton()
    return found


_AUTOMATON = _automaton()


def _notice(comments: list[str], project: str | None) -> str | None:
    """The verdict of the first comment line that a rule confirms; the automaton says which rules to try on which line."""
    for text in comments:
        text = QUOTED.sub(" ", text)
        tried: set[int] = set()
        for _, numbers in _AUTOMATON.iter(text.lower()):
            tried.update(numbers)
        for number in sorted(tried, reverse=True):
            if number < 0:
                owner = OWNER.search(text)
                if owner and project and owner.group(1).lower() not in (project.lower(), "authors"):
                    return "vendored"
            elif _RULES[number][1].search(text):
                return _RULES[number][0]
    return None


def provenance(path: str, text: str, project: str | None = None) -> str | None:
    """Why a file is not hand-written: vendored, generated, minified, data, lockfile; None for hand-written source.

    JSON and Markdown files are never named, save for lockfiles of other kinds. Empty texts are judged by path only.
    """
    if NOT_CODE.search(path):
        return None
    if LOCKFILE.search(path):
        return "lockfile"
    if VENDORED.search(path):
        return "vendored"
    text = text.replace("\r\n", "\n")
    python = path.endswith(".py")
    said = _notice(_comments(text.split("\n"), python), project)
    if said:
        return said
    if GENERATED_PATH.search(path):
        return "generated"
    if MINIFIED_PATH.search(path):
        return "minified"
    return _by_content(text, python)


def _by_content(text: str, python: bool) -> str | None:
    raw = text.encode("utf-8", "replace")
    code = _HASH_COMMENT.sub(b"", _DOCSTRING.sub(b"", raw)) if python else _SLASH_COMMENT.sub(b"", raw)
    lines = [x for x in (y.strip() for y in code.split(b"\n")) if x]
    size = sum(map(len, lines))
    if not size:
        return None
    # what is handed to a function is code, however many literals it has
    literals = LITERALS.findall(_CALL_LINE.sub(b"", code))
    if len(literals) >= DATA_LITERALS:
        lengths = list(map(len, literals))
        # one long text (a query, a message) does not make a file data
        held = sum(lengths) - (max(lengths) if max(lengths) > 0.2 * size else 0)
        if held >= DATA_SHARE * size:
            return "data"
        rows = sum(1 for x in lines if x[:1] in b"\"'`[({-0123456789]})" and not LITERALS.sub(b"", x).strip(b" \t,;:()[]{}|+-=>#"))
        if len(lines) >= DATA_LITERALS and rows >= 0.7 * len(lines):
            return "data"
    if size / len(lines) >= MINIFIED_LINE and (code.count(b" ") + code.count(b"\t")) <= MINIFIED_SPACE * len(code):
        return "minified"
    return None


def file_provenance(chunks: DataFrame) -> DataFrame:
    """(file_path, project, provenance) for every file of the chunks; provenance is null for hand-written source.

    Decided per file from its path and whole text: notices and banners in the comments at its top and end, found by one
    automaton over all phrases, path rules, and for data and minified code the shares of literals, line length and white
    space. A null project only switches off the comparison of the
    copyright's owner with the project. An empty table gives no rows.
    """
    return map_files(chunks, lambda path, text, project: [(path, project, provenance(path, text, project))], "file_path string, project string, provenance string", project=True)
