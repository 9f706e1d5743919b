"""Column functions over text, queries, paths and source code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as Python's \w+ finds them; Java's \w is ASCII only.
WORD = r"([\p{L}\p{N}_]+)"
ASCII_WORD = r"([A-Za-z0-9_]+)"

# Words that are no search terms.
SEARCH_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into",
    "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "and", "but", "if", "or", "because", "until", "while", "that", "which", "who", "whom", "this", "these", "those",
    "what", "find", "search", "locate", "show", "me", "i", "my", "we", "our",
)
# Words that are left out when terms are compared with symbols.
SYMBOL_STOPWORDS = (
    "the", "a", "an", "is", "are", "in", "for", "to", "of", "and", "or", "how", "where", "what", "find",
)
# Words counted as filler when a query is profiled.
PROFILE_STOPWORDS = (
    "the", "a", "an", "is", "are", "in", "for", "to", "of", "and", "or", "how", "where", "what", "find", "show", "with", "from", "does", "do", "using",
    "use",
)
# Words that mark natural language.
CUE_WORDS = (
    "where", "how", "what", "which", "find", "search", "locate", "handles", "implements", "does", "manages", "processes", "flow", "logic", "related",
    "responsible", "dealing",
)
# Shapes of identifiers, files and patterns.
REGEX_META = r"[\\^$|?*+()\[\]{}]"
QUOTED = r"\"([^\"]+)\"|'([^']+)'"
CAMEL = r"\b[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b"
SNAKE = r"\b[a-z0-9]+_[a-z0-9_]+\b"
DOTTED = r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z0-9_.-]+\b"
FILE_EXT = r"\.[a-zA-Z0-9]{1,6}\b"
# Languages by extension; others are named by the extension itself.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "swift": "swift", "go": "go", "rs": "rust", "rb": "ruby", "java": "java", "kt": "kotlin",
    "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "md": "markdown", "yml": "yaml", "yaml": "yaml", "json": "json",
}
# What a query may call a language.
LANGUAGE_ALIASES = {
    "python": ("py", "python"),
    "typescript": ("ts", "tsx", "typescript"),
    "javascript": ("js", "jsx", "javascript"),
    "tsx": ("tsx", "typescript"),
    "jsx": ("jsx", "javascript"),
    "swift": ("swift",),
    "go": ("go", "golang"),
    "rust": ("rs", "rust"),
    "ruby": ("rb", "ruby"),
    "java": ("java",),
    "kotlin": ("kt", "kotlin"),
    "c": ("c",),
    "cpp": ("cpp", "c++", "cc", "hpp"),
    "markdown": ("md", "markdown"),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
}


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def search_terms(query: Column) -> Column:
    """X11: lower-cased words of three letters or more that are no stop words, in order, with repeats."""
    stop = _strings(SEARCH_STOPWORDS)
    return F.filter(words(F.lower(F.coalesce(query, F.lit("")))), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def symbol_terms(query: Column) -> Column:
    """The distinct terms that are looked for in symbols."""
    stop = _strings(SYMBOL_STOPWORDS)
    return F.array_distinct(F.filter(words(F.lower(F.coalesce(query, F.lit("")))), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def share(terms: Column, test) -> Column:
    """The share of terms that pass; 0 without terms."""
    return F.coalesce(F.try_divide(F.size(F.filter(terms, test)).cast("double"), F.size(terms).cast("double")), F.lit(0.0))


def symbol_match(query: Column, symbols: Column) -> Column:
    """X4"""
    text = F.lower(F.array_join(F.coalesce(symbols, F.expr("cast(array() as array<string>)")), " "))
    return F.when(F.size(symbols) > 0, share(symbol_terms(query), lambda t: F.contains(text, t))).otherwise(0.0)


def lexical_overlap(query: Column, preview: Column, symbols: Column) -> Column:
    """X5"""
    text = F.lower(F.concat(F.coalesce(preview, F.lit("")), F.lit(" "), F.coalesce(F.array_join(symbols, " "), F.lit(""))))
    return share(search_terms(query), lambda t: F.contains(text, t))


def recency(last_modified: Column, now: Column, half_life_days: float = 30.0) -> Column:
    """0.5 ** (age / half life); 0 without a time."""
    age = F.greatest(F.lit(0.0), (now - last_modified) / 86400.0)
    return F.when(last_modified > 0, F.pow(F.lit(0.5), age / max(1.0, half_life_days))).otherwise(0.0)


def language_match(query: Column, language: Column) -> Column:
    """Whether the query names the language."""
    aliases = F.create_map(*[x for k, v in LANGUAGE_ALIASES.items() for x in (F.lit(k), _strings(v))])
    lang = F.lower(language)
    named = F.arrays_overlap(F.coalesce(aliases[lang], F.array(lang)), search_terms(query))
    return F.when(F.coalesce(language, F.lit("")) == "", 0.0).when(named, 1.0).otherwise(0.0)


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs in a text, without overlaps; 0 for an empty term."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")).otherwise(0)


def grep_relevance(preview: Column, file_path: Column, terms: list[str], lines: Column, base: float = 1.0) -> Column:
    """Term frequency, a bonus for the file's name and one for density, times the base, 1 at most."""
    text, name = F.lower(preview), F.lower(path_name(file_path))
    kept = [t.lower() for t in terms if t]
    n = sum((occurrences(text, F.lit(t)) for t in kept), F.lit(0))
    frequency = F.when(n > 0, F.least(F.lit(0.7), 0.3 + 0.4 * F.log(1.0 + n) / F.log(F.lit(10.0)))).otherwise(0.0)
    named = F.lit(False)
    for t in kept:
        named = named | F.contains(name, F.lit(t))
    density = F.when((n > 0) & (lines > 0), F.least(F.lit(0.1), n / lines * 0.05)).otherwise(0.0)
    return F.least(F.lit(1.0), (frequency + F.when(named, 0.2).otherwise(0.0) + density) * base)


def is_natural_language(query: Column) -> Column:
    """F8"""
    parts = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.when(F.size(parts) <= 1, False).otherwise(F.arrays_overlap(parts, _strings(CUE_WORDS)) | (F.size(parts) >= 3))


def is_identifier_like(query: Column) -> Column:
    """F9"""
    q = F.trim(F.coalesce(query, F.lit("")))
    short = words(q, ASCII_WORD)
    shape = F.rlike(q, F.lit(CAMEL)) | F.rlike(q, F.lit(SNAKE)) | F.rlike(q, F.lit(DOTTED)) | F.rlike(q, F.lit(FILE_EXT))
    return (q != "") & (shape | ((F.size(short) <= 2) & F.exists(short, lambda w: F.length(w) >= 3)))


def query_profile(query: Column) -> Column:
    """struct(query_type, confidence, word_count, camel_ratio, stop_ratio, regex)."""
    q = F.trim(F.coalesce(query, F.lit("")))
    found = words(q, ASCII_WORD)
    n = F.size(found)
    stop = _strings(PROFILE_STOPWORDS)
    camel = F.coalesce(F.try_divide(F.size(F.filter(found, lambda w: F.rlike(w, F.lit(CAMEL)))).cast("double"), n.cast("double")), F.lit(0.0))
    filler = F.coalesce(F.try_divide(F.size(F.filter(found, lambda w: F.array_contains(stop, F.lower(w)))).cast("double"), n.cast("double")), F.lit(0.0))
    regex = F.rlike(q, F.lit(REGEX_META))
    identifier = F.when(is_identifier_like(q), 0.6).otherwise(0.0) + F.when(camel >= 0.4, 0.3).otherwise(0.0)
    natural = F.when((n >= 4) | (filler >= 0.3), 0.6).otherwise(0.0) + F.when(n >= 6, 0.2).otherwise(0.0)
    # the reference's second pattern test can hardly match; only the first counts (Q4)
    pattern = F.when(regex, 0.7).otherwise(0.0)
    best = F.greatest(identifier, natural, pattern)
    kind = F.when(n == 0, "identifier").when(identifier == best, "identifier").when(natural == best, "natural_language").otherwise("pattern")
    return F.struct(
        kind.alias("query_type"),
        F.when(n == 0, 0.5).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), best))).alias("confidence"),
        n.alias("word_count"),
        camel.alias("camel_ratio"),
        filler.alias("stop_ratio"),
        F.when((n > 0) & regex, 1.0).otherwise(0.0).alias("regex"),
    )


def quoted(query: Column) -> Column:
    """The texts in quotes."""
    return F.transform(F.regexp_extract_all(query, F.lit("(" + QUOTED + ")"), 1), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))


def strip_quotes(query: Column) -> Column:
    return F.regexp_replace(query, QUOTED, "$1$2")


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def path_suffix(path: Column) -> Column:
    """The lower-cased extension without its dot; empty without one."""
    return F.lower(F.regexp_extract(path_name(path), r"[^.]\.([^.]+)$", 1))


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), r"(?<=[^.])\.[^.]+$", "")


def language_for_path(path: Column) -> Column:
    """P14"""
    names = F.create_map(*[F.lit(x) for item in LANGUAGES.items() for x in item])
    return F.coalesce(names[path_suffix(path)], path_suffix(path))


def content_hash(text: Column) -> Column:
    """The first twelve hexadecimal digits of the MD5."""
    return F.substring(F.md5(text), 1, 12)


def python_symbols(text: Column) -> Column:
    """Names of the first five different definitions."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)"), 1)), 1, 5)


# What an import looks like, by language.
IMPORTS = {
    "python": (r"(?m)^\s*import\s+([A-Za-z0-9_\.]+)", r"(?m)^\s*from\s+([A-Za-z0-9_\.]+)\s+import"),
    "javascript": (r"import\s+.*?from\s+[\"']([^\"']+)[\"']", r"require\([\"']([^\"']+)[\"']\)"),
    "typescript": (r"import\s+.*?from\s+[\"']([^\"']+)[\"']", r"require\([\"']([^\"']+)[\"']\)"),
    "go": (r"import\s+\"([^\"]+)\"",),
    "java": (r"(?m)^\s*import\s+([A-Za-z0-9_\.]+)",),
    "kotlin": (r"(?m)^\s*import\s+([A-Za-z0-9_\.]+)",),
    "rust": (r"(?m)^\s*use\s+([A-Za-z0-9_:]+)",),
    "swift": (r"(?m)^\s*import\s+([A-Za-z0-9_]+)",),
    "c": (r"#include\s+[<\"]([^>\"]+)[>\"]",),
    "cpp": (r"#include\s+[<\"]([^>\"]+)[>\"]",),
}


def imports(language: Column, text: Column) -> Column:
    """The sorted, distinct imports of a text; empty for languages without a rule."""
    out = None
    for name, patterns in IMPORTS.items():
        found = F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in patterns])))
        out = F.when(language == name, found) if out is None else out.when(language == name, found)
    return out.otherwise(F.expr("cast(array() as array<string>)"))


def rich_text(root: str = "") -> Column:
    """The text that is embedded for a chunk row: a header of its metadata, then its content."""

    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"[{label}="), value, F.lit("]")))

    path = F.col("file_path")
    if root:
        path = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(path)
    doc = F.trim(F.substring(F.replace(F.trim(F.regexp_replace("docstring", r"^\s+|\s+$", "")), F.lit("\n"), F.lit(" ")), 1, 200))
    header = F.concat_ws(
        " ",
        part("LANG", F.col("language")),
        F.concat(F.lit("[FILE="), path, F.lit("]")),
        F.concat(F.lit("[LINES="), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]")),
        part("SYMBOLS", F.array_join(F.slice("symbols", 1, 5), ", ")),
        part("PARENT", F.col("parent_symbol")),
        part("TYPE", F.col("chunk_type")),
        part("IMPORTS", F.array_join(F.slice("imports", 1, 5), ", ")),
        part("DOC", doc),
    )
    return F.concat(header, F.lit("\n"), F.coalesce("content", F.lit("")))


def truncated(text: Column, width: int = 80) -> Column:
    """A line cut to the width, with dots for what is missing."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def score_label(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def speed_label(milliseconds: Column) -> Column:
    return F.when(milliseconds < 50, "fast").when(milliseconds < 200, "ok").otherwise("slow")


def normalised_text(text: Column) -> Column:
    """White space collapsed, as duplicate previews are compared."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x1c-\x1f\x85 ]+", " "))


def iso_time(seconds: Column) -> Column:
    """Epoch seconds as an ISO time in UTC, to the second."""
    return F.date_format(F.timestamp_micros((seconds * 1_000_000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss")


def json_list(text: Column) -> Column:
    """A list from its JSON text, or from a comma list where that is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.filter(F.split(text, ","), lambda s: s != ""))
