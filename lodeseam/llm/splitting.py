"""Splitting oversized chunks at natural boundaries (problem 1)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_CLOSER = re.compile(r"^\s*(?:[\])}]+[;,)]*|end\b.*|</\w+>)\s*$")
_OPENER = re.compile(r"^\s*(?:(?:export|public|private|protected|static|async|pub|abstract|final)\b|def\b|class\b|func\b|fn\b|function\b|interface\b|impl\b|#{1,6} |@\w|///|/\*\*)")
_SENTENCE = re.compile(r"[.!?:;…。]['\")\]]?\s*$")
_CUT = re.compile(r"\s+|(?<=[,;.)\]}])")


def boundaries(lines: list[str]) -> list[list[int]]:
    """Line numbers (0-based) behind which a piece may end, by rank: units, paragraphs, blocks and sentences, any line."""
    n = len(lines)
    indent = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    base = min((x for x in indent if x is not None), default=0)
    after: list[int | None] = [None] * n  # indentation of the next line that is not blank
    following, nxt = None, n
    opens = [False] * n
    for k in range(n - 1, -1, -1):
        after[k] = following
        opens[k] = nxt < n and bool(_OPENER.match(lines[nxt]))
        if indent[k] is not None:
            following, nxt = indent[k], k
    ranks: list[list[int]] = [[], [], [], []]
    for k in range(n - 1):
        blank = not lines[k + 1].strip()
        inner = indent[k]
        if inner is not None and after[k] is not None and (blank or _CLOSER.match(lines[k])) and (after[k] <= base or (opens[k] and after[k] <= inner)):
            ranks[0].append(k)
        if inner is not None and blank:
            ranks[1].append(k)
        if inner is not None and after[k] is not None and (after[k] < inner or _CLOSER.match(lines[k]) or _SENTENCE.search(lines[k])):
            ranks[2].append(k)
        ranks[3].append(k)
    return ranks


def split_text(text: str, start_line: int = 1, limit: int = 2000, overlap: int = 3, keep_blank: bool = False) -> list[tuple[int, int, str]]:
    """(start_line, end_line, content) of pieces of at most ``limit`` code points.

    Prefix sums of the lines' lengths and sorted arrays of boundaries are searched by bisection for the last boundary
    under the limit, best rank first as long as the piece is at least half full. The next piece repeats the last
    ``overlap`` lines, fewer where the limit leaves no room for a new line, none within a line. A line longer than the
    limit is cut at its last gap between words or behind punctuation, and hard at the limit where there is none.
    A text within the limit is its own single piece; blank pieces are left out unless
    ``keep_blank`` is set.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    total = len(text)
    if total <= limit:
        return [(start_line, start_line + text.count("\n"), text)]
    lines = text.split("\n")
    ends = list(accumulate(len(x) + 1 for x in lines))  # offset behind line k and its line end
    starts = [0, *ends[:-1]]
    ranks = boundaries(lines)
    pieces: list[tuple[int, int, str]] = []

    def emit(begin: int, end: int, last: int) -> None:
        part = text[begin:end]
        if keep_blank or part.strip():  # a blank piece would say nothing
            pieces.append((start_line + bisect_right(starts, begin) - 1, start_line + last, part))

    begin = fresh = 0  # where the piece starts; the first text that no piece holds yet
    while fresh < total:
        if begin + limit >= total:
            emit(begin, total, len(lines) - 1)
            break
        last = bisect_right(ends, begin + limit + 1) - 1
        line = bisect_right(starts, fresh) - 1
        if last < line:
            if begin < fresh:  # less overlap
                begin = min(fresh, starts[bisect_right(starts, begin)])
                continue
            gaps = [m.end() for m in _CUT.finditer(text, fresh, fresh + limit) if m.end() > fresh + limit // 2]
            cut = gaps[-1] if gaps else fresh + limit
            emit(begin, cut, line)
            begin = fresh = cut
            continue
        least = max(line, bisect_left(ends, begin + limit // 2))
        for rank in ranks:
            k = bisect_right(rank, last) - 1
            if k >= 0 and rank[k] >= least:
                last = rank[k]
                break
        emit(begin, ends[last] - 1, last)
        fresh = ends[last]
        begin = max(starts[max(0, last + 1 - overlap)], min(fresh, starts[bisect_right(starts, begin)])) if overlap else fresh
    return pieces


PIECES = "chunk_id string, project string, file_path string, piece int, pieces int, start_line int, end_line int, chunk_type string, language string, content string"


def split_oversized(chunks: DataFrame, limit: int = 2000, overlap: int = 3) -> DataFrame:
    """The pieces of every chunk with more than ``limit`` code points; smaller chunks give no rows.

    Repeated rows of a chunk count once, the version indexed last; a chunk without id is told by its place and text.
    Nulls: a null content is empty, a null start_line is 1; chunk_type, language and the rest pass through as they are.
    end_line is computed from the text, so a null or wrong one does no harm. Further columns are left out, whatever
    their names. Only oversized texts are shuffled and reach Python; every chunk is looked at.
    """
    struct = StructType.fromDDL(PIECES)
    arrow = to_arrow_schema(struct)
    large = F.length("content") > limit
    value = ["project", "file_path", "start_line", "chunk_type", "language"]
    key = F.coalesce(F.col("chunk_id"), F.concat(F.lit("\0"), F.coalesce("file_path", F.lit("")), F.lit("\0"), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit("\0"), F.md5(F.coalesce("content", F.lit("")))))
    latest = (
        chunks.select(key.alias("key"), "chunk_id", "indexed_at", *[F.when(large, F.col(c)).alias(c) for c in value], F.when(large, F.col("content")).alias("content"))
        .groupBy("key")
        .agg(F.max(F.struct("indexed_at", "chunk_id", "content", *value)).alias("row"))
        .select("row.chunk_id", *[f"row.{c}" for c in value], "row.content")
        .filter(F.col("content").isNotNull())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                chunk_id, project, path, start, kind, language, content = row
                # a text of white space only has blank pieces, so every chunk has some
                pieces = split_text(content, start if start is not None else 1, limit, overlap, not content.strip())
                out.extend((chunk_id, project, path, k, len(pieces), a, b, kind, language, part) for k, (a, b, part) in enumerate(pieces))
                if len(out) >= 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return latest.mapInArrow(run, struct)
