"""Source files that do not parse (problem 3)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.sources.assembly import map_files
from lodeseam.llm.syntax import language_of, parses

# Words and marks that are common in one language and rare in the others.
HINTS = {
    "python": r"\bdef \w+\(|\bself\b|\bNone\b|\belif\b|^\s*from \S+ import|:\s*$",
    "javascript": r"\bconst\b|\bfunction\b|=>|===|\brequire\(|^import .* from ",
    "typescript": r"\b(?:interface|readonly|implements)\b|: (?:string|number|boolean|void|any)\b|Promise<",
    "go": r"\bfunc\b|:=|^package \w+$|\bnil\b|\bchan\b|\bdefer\b",
    "java": r"\b(?:public|private|protected) |\bvoid\b|^import [\w.]+;|\bextends\b|\bnew \w+<",
    "rust": r"\bfn\b|\blet mut\b|\bimpl\b|->|::|\bpub\b|&str\b",
    "json": r'^\s*"[^"]*"\s*:|^\s*[{}\[\]],?\s*$',
}
_HINTS = {k: re.compile(v, re.M) for k, v in HINTS.items()}


def ranked_languages(text: str) -> list[str]:
    """The supported languages, likeliest first by the tokens in the text; ties in alphabetical order."""
    counts = {k: len(v.findall(text)) for k, v in _HINTS.items()}
    return sorted(counts, key=lambda k: (-counts[k], k))


def verdict(path: str, text: str, java_trailing_comma: bool = False) -> tuple[str | None, bool, str | None]:
    """(language of the extension, parses, language it parses as instead).

    A file that its own grammar refuses is tried against all others in the order of their tokens: one that parses
    elsewhere has a wrong extension, one that parses nowhere is corrupt (third value null). Files of unknown
    extensions, Markdown and empty files (save JSON and Go) always parse.
    """
    language = language_of(path)
    if parses(text, language, java_trailing_comma):
        return language, True, None
    if text.strip():
        for other in ranked_languages(text):
            # TypeScript and JSON texts are nearly always JavaScript too, and prose may be a Python expression
            if other != language and parses(text, other, java_trailing_comma):
                return language, False, other
    return language, False, None


def file_syntax(chunks: DataFrame, java_trailing_comma: bool = False) -> DataFrame:
    """(file_path, project, language, parses, parses_as) for every file of the chunks.

    language is that of the extension. java_trailing_comma accepts a comma before the closing bracket of a Java
    parameter list, which compilers refuse. Rows without file_path are left out; null contents are blank; a null
    project stays null. An empty table gives no rows.
    """

    def run(path: str, text: str, project: str | None):
        yield path, project, *verdict(path, text, java_trailing_comma)

    return map_files(chunks, run, "file_path string, project string, language string, parses boolean, parses_as string", project=True)


def failure_rates(files: DataFrame) -> DataFrame:
    """Files, files that do not parse and their rate per project and language, from the rows of file_syntax."""
    failed = F.sum(F.when(~F.col("parses"), 1).otherwise(0))
    return files.groupBy("project", "language").agg(
        F.count("*").alias("files"),
        failed.alias("failed"),
        F.sum(F.when(F.col("parses_as").isNotNull(), 1).otherwise(0)).alias("wrong_extension"),
        (failed / F.count("*")).alias("failure_rate"),
    )
