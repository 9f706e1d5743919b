"""Deciding what a query runs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.functions.text import CAMEL, CUE_WORDS, DOTTED, FILE_EXT, QUOTED, REGEX_META, SNAKE, quoted, strip_quotes, words

# Words that speak for a semantic search.
SEMANTIC_CUES = (
    "where", "how", "what", "why", "show", "find", "handle", "handles", "implement", "implements", "validate", "validates", "called", "calls", "used",
    "usage", "flow",
)
# Words that are never picked as a pattern.
TOKEN_STOPWORDS = (
    "the", "and", "or", "to", "of", "in", "on", "for", "with", "from", "where", "how", "what", "why", "show", "find", "we", "is", "are", "does", "do",
    "it", "this", "that", "a", "an",
)
# Related terms by concept.
CONCEPTS = {
    "authentication": ("auth", "login", "signin", "sign-in", "authenticate", "session", "token", "jwt", "oauth"),
    "auth": ("authentication", "login", "signin", "authenticate", "session", "token"),
    "login": ("signin", "sign-in", "authenticate", "auth", "session"),
    "logout": ("signout", "sign-out", "session destroy", "clear session"),
    "database": ("db", "sql", "query", "model", "repository", "persistence", "storage"),
    "db": ("database", "sql", "query", "model", "repository"),
    "query": ("sql", "database", "fetch", "select", "find"),
    "api": ("endpoint", "route", "handler", "controller", "rest", "http"),
    "endpoint": ("api", "route", "handler", "path"),
    "route": ("endpoint", "path", "url", "handler", "controller"),
    "request": ("http", "api", "fetch", "call"),
    "response": ("http", "return", "result", "reply"),
    "error": ("exception", "catch", "throw", "failure", "fault", "crash"),
    "exception": ("error", "catch", "throw", "try"),
    "handling": ("handler", "catch", "process", "manage"),
    "flow": ("process", "pipeline", "sequence", "chain", "workflow"),
    "pipeline": ("flow", "process", "chain", "sequence"),
    "state": ("store", "redux", "context", "data", "model"),
    "store": ("state", "redux", "storage", "persist"),
    "test": ("spec", "unit", "integration", "mock", "assert", "expect"),
    "mock": ("stub", "fake", "spy", "test double"),
    "config": ("configuration", "settings", "options", "preferences", "env"),
    "settings": ("config", "configuration", "options", "preferences"),
    "validation": ("validate", "check", "verify", "sanitize", "parse"),
    "validate": ("check", "verify", "validation", "sanitize"),
    "cache": ("memoize", "store", "persist", "buffer"),
    "async": ("await", "promise", "concurrent", "parallel", "task"),
    "concurrent": ("async", "parallel", "thread", "dispatch"),
    "render": ("display", "view", "component", "draw", "show"),
    "component": ("view", "widget", "element", "ui"),
    "view": ("screen", "page", "component", "ui", "display"),
    "navigation": ("navigate", "router", "route", "coordinator", "flow"),
    "router": ("navigation", "route", "coordinator"),
    "network": ("http", "api", "fetch", "request", "connection"),
    "fetch": ("request", "get", "load", "download", "http"),
    "file": ("io", "read", "write", "stream", "path"),
    "read": ("load", "parse", "fetch", "get"),
    "write": ("save", "store", "persist", "output"),
    "security": ("auth", "encryption", "permission", "access", "secure"),
    "encryption": ("encrypt", "decrypt", "hash", "crypto"),
    "permission": ("access", "authorize", "role", "acl"),
}


@dataclass(frozen=True)
class QueryPlan:
    """D8"""

    mode: str = "exact"
    run_grep: bool = False
    run_semantic: bool = False
    run_ast: bool = False
    grep_pattern: str | None = None
    grep_fixed: bool = False
    semantic_query: str | None = None
    ast_patterns: tuple[str, ...] = ()
    ast_rules: tuple[str, ...] = ()
    ast_language: str | None = None
    ast_exhaustive: bool = False
    confidence: float = 0.0

    def describe(self) -> str:
        """The stages in plain words."""
        stages = []
        if self.run_grep:
            stages.append(f"grep {'literal' if self.grep_fixed else 'pattern'} {self.grep_pattern!r}")
        if self.run_semantic:
            stages.append(f"semantic {self.semantic_query!r}")
        if self.run_ast:
            stages.append(f"structural {', '.join(self.ast_patterns + self.ast_rules)}" + (" on all files" if self.ast_exhaustive else " on files found so far"))
        return f"{self.mode} ({self.confidence:.2f}): " + ("; ".join(stages) or "nothing to run")


def quoted_parts(query: str) -> list[str]:
    return [a or b for a, b in re.findall(QUOTED, query)]


def grep_token(query: str) -> str | None:
    """The quoted text, else the first identifier, else the longest word that says something."""
    if parts := quoted_parts(query):
        return parts[0]
    for shape in (CAMEL, SNAKE, DOTTED):
        if m := re.search(shape, query):
            return m.group()
    candidates = [t for t in re.findall(r"[A-Za-z0-9_./:-]+", query) if len(t) >= 3]
    telling = [t for t in candidates if t.lower() not in TOKEN_STOPWORDS]
    return max(telling or candidates, key=len, default=None)


def plan_query(
    query: str,
    grep_only: bool = False,
    semantic_only: bool = False,
    precise: bool = False,
    ast_patterns: tuple[str, ...] = (),
    ast_rules: tuple[str, ...] = (),
    ast_language: str | None = None,
    ast_exhaustive: bool = False,
    strategy: str | None = None,
) -> QueryPlan:
    """The engines a query runs, decided by its shape. A codemod without patterns is refused (Q6)."""
    q = query.strip()
    structural = dict(run_ast=bool(ast_patterns or ast_rules), ast_patterns=tuple(ast_patterns), ast_rules=tuple(ast_rules), ast_language=ast_language)
    if strategy == "codemod":
        if not structural["run_ast"]:
            raise ValueError("a codemod needs a structural pattern or rule")
        if q:
            return QueryPlan(**structural, ast_exhaustive=True, confidence=0.9)
    if not q:
        if not structural["run_ast"]:
            return QueryPlan(**structural, ast_exhaustive=ast_exhaustive)
        return QueryPlan(**structural, ast_exhaustive=True, confidence=0.8 if ast_exhaustive else 0.5)
    grep_only = grep_only or strategy == "grep"
    found = re.findall(r"[A-Za-z0-9_]+", q)
    has_quotes, is_regex = bool(quoted_parts(q)), bool(re.search(REGEX_META, q))
    natural = len(found) >= 4 or any(w.lower() in SEMANTIC_CUES for w in found)
    grep = 0.7 * has_quotes + 0.5 * any(re.search(s, q) for s in (CAMEL, SNAKE, DOTTED)) + 0.3 * bool(re.search(FILE_EXT, q)) + 0.6 * is_regex
    semantic = 0.6 * natural + 0.2 * (len(found) >= 6)
    if grep_only:
        mode = "exact"
    elif semantic_only:
        mode = "semantic"
    elif re.fullmatch(QUOTED, q) or (is_regex and not has_quotes and not natural) or (grep >= 0.9 and semantic <= 0.3):
        mode = "exact"
    elif semantic >= 0.7 and grep <= 0.4:
        mode = "semantic"
    else:
        mode = "hybrid"
    run_grep, run_semantic = mode != "semantic", mode != "exact"
    pattern = (q if grep_only else grep_token(q)) if run_grep else None
    fixed = run_grep and ((not is_regex) if grep_only else bool(pattern and has_quotes))
    confidence = max(grep, semantic)
    if mode == "hybrid":
        confidence = min(0.9, max(0.4, confidence))
    if precise and run_grep and not run_semantic:
        confidence = max(confidence, 0.8)
    text = (re.sub(QUOTED, lambda m: m.group(1) or m.group(2) or "", q).strip() or q) if run_semantic else None
    return QueryPlan(mode, run_grep, run_semantic, grep_pattern=pattern, grep_fixed=fixed, semantic_query=text, ast_exhaustive=ast_exhaustive, confidence=min(1.0, confidence), **structural)


def plan_columns(query: Column) -> Column:
    """The plan of plan_query without options as a struct(mode, grep_pattern, grep_fixed, semantic_query, confidence), for many queries at once."""
    q = F.trim(F.coalesce(query, F.lit("")))
    parts, found = quoted(q), words(q, r"([A-Za-z0-9_]+)")
    matches = lambda p: F.rlike(q, F.lit(p))
    has_quotes, is_regex = F.size(parts) > 0, matches(REGEX_META)
    natural = (F.size(found) >= 4) | F.exists(found, lambda w: F.lower(w).isin(*SEMANTIC_CUES))
    weight = lambda c, v: F.when(c, v).otherwise(0.0)
    grep = weight(has_quotes, 0.7) + weight(matches(CAMEL) | matches(SNAKE) | matches(DOTTED), 0.5) + weight(matches(FILE_EXT), 0.3) + weight(is_regex, 0.6)
    semantic = weight(natural, 0.6) + weight(F.size(found) >= 6, 0.2)
    exact = F.rlike(q, F.lit(f"^(?:{QUOTED})$")) | (is_regex & ~has_quotes & ~natural) | ((grep >= 0.9) & (semantic <= 0.3))
    mode = F.when(q == "", "exact").when(exact, "exact").when((semantic >= 0.7) & (grep <= 0.4), "semantic").otherwise("hybrid")
    tokens = F.filter(F.regexp_extract_all(q, F.lit(r"([A-Za-z0-9_./:-]+)"), 1), lambda t: F.length(t) >= 3)
    telling = F.filter(tokens, lambda t: ~F.lower(t).isin(*TOKEN_STOPWORDS))
    longest = lambda a: F.aggregate(a, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    some = lambda c: F.when(c != "", c)
    first = lambda p: some(F.regexp_extract(q, "(" + p + ")", 1))
    token = F.coalesce(F.try_element_at(parts, F.lit(1)), first(CAMEL), first(SNAKE), first(DOTTED), some(longest(telling)), some(longest(tokens)))
    runs_grep, runs_semantic = (mode != "semantic") & (q != ""), mode != "exact"
    top = F.greatest(grep, semantic)
    text = F.trim(strip_quotes(q))
    return F.struct(
        mode.alias("mode"),
        F.when(runs_grep, token).alias("grep_pattern"),
        (runs_grep & has_quotes).alias("grep_fixed"),
        F.when(runs_semantic, F.when(text != "", text).otherwise(q)).alias("semantic_query"),
        F.when(q == "", 0.0).when(mode == "hybrid", F.least(F.lit(0.9), F.greatest(F.lit(0.4), top))).otherwise(F.least(F.lit(1.0), top)).alias("confidence"),
    )


def expand_query(query: str, most: int = 5, concepts: dict[str, list[str]] | None = None) -> list[str]:
    """The query, then variants with related terms in its place or behind it, in the order they arise (Q2)."""
    table = CONCEPTS if concepts is None else concepts
    low = query.lower()
    parts = low.split()
    if len(parts) <= 1 or not (len(parts) >= 3 or any(w in CUE_WORDS for w in parts)):
        return [query]
    variants = [low.replace(w, t) for w in parts for t in table.get(w, [])[:3]]
    variants += [f"{low} {t}" for w in parts for t in table.get(w, [])[:2]]
    return list(dict.fromkeys([query, *variants]))[:most]


def expansions(query: Column, most: int = 5) -> Column:
    """X13 as an array expression, for many queries at once."""
    table = F.create_map(*[x for k, v in CONCEPTS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v[:3]]))])
    none = F.expr("cast(array() as array<string>)")
    low = F.lower(query)
    parts = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    related = lambda w: F.coalesce(table[w], none)
    replaced = F.flatten(F.transform(parts, lambda w: F.transform(related(w), lambda t: F.replace(low, w, t))))
    added = F.flatten(F.transform(parts, lambda w: F.transform(F.slice(related(w), 1, 2), lambda t: F.concat(low, F.lit(" "), t))))
    natural = (F.size(parts) > 1) & ((F.size(parts) >= 3) | F.arrays_overlap(parts, F.array(*[F.lit(w) for w in CUE_WORDS])))
    return F.when(natural, F.slice(F.array_distinct(F.concat(F.array(query), replaced, added)), 1, most)).otherwise(F.array(query))


def expanded_queries(query: str, expander: Callable[[str], list[str] | None] | None = None, cache: dict[str, list[str]] | None = None) -> list[str]:
    """From a pluggable expander (its answers may be kept in a cache), else from the concepts; the query comes first."""
    got = None
    if expander is not None:
        got = cache.get(query) if cache is not None else None
        if got is None:
            got = expander(query)
            if cache is not None and got:
                cache[query] = got
    return list(dict.fromkeys([query, *(got or expand_query(query))]))


