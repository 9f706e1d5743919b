"""Source files put together from their chunk rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_rows(chunks: DataFrame, *extra: str) -> DataFrame:
    """The chunk rows that files are made of, with copies collapsed before anything is moved.

    Each Arrow batch of a map task keeps one row per version of a chunk, so a chunk repeated any number of times travels
    once per batch; ``assemble`` passes over the copies that are left. Rows without a file_path belong to no file and
    are left out; a null start_line counts as 1, a null content as "".
    """
    rows = chunks.filter(F.col("file_path").isNotNull()).select(
        "file_path", F.coalesce("start_line", F.lit(1)).cast("int").alias("start_line"), F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("content", F.lit("")).alias("content"), *extra, "indexed_at"
    )
    keys = [c for c in rows.columns if c != "indexed_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.table(batch).group_by(keys, use_threads=False).aggregate([("indexed_at", "max")])
            yield from kept.rename_columns([*keys, "indexed_at"]).select(batch.schema.names).cast(batch.schema).to_batches()

    return rows.mapInArrow(run, rows.schema)


def map_files(chunks: DataFrame, function: Callable[[str, str, str | None], Iterator[tuple]], schema: pa.Schema | str, project: bool = False) -> DataFrame:
    """Rows of ``function(file_path, text, project)`` for every file, as a DataFrame of the given DDL schema.

    A file's text: the k-th line of a chunk is line start_line + k - 1; of two versions of a chunk the one indexed last
    counts; lines that no chunk covers are blank. The text is moved once: rows are partitioned by file, arrive sorted by
    file and line, and one file at a time is held in memory, whatever the size of its project. Nothing is collected.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(schema)
    extra = ("project",) if project else ()
    rows = (
        chunk_rows(chunks, *extra)
        .repartition("file_path")
        .sortWithinPartitions("file_path", "start_line", "chunk_id", F.col("indexed_at").desc_nulls_last())
        .select("file_path", "start_line", "chunk_id", "content", *extra)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)
        out: list[tuple] = []
        for path, text, owner in assemble(batches, project):
            out.extend(function(path, text, owner))
            if len(out) >= 2000:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return rows.mapInArrow(run, struct)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def assemble(batches: Iterator[pa.RecordBatch], project: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """(file_path, text, project) from batches sorted by file_path, start_line, chunk_id and latest version first."""
    path, owner, lines, last = None, None, [], None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for k, p in enumerate(columns[0]):
            if p != path:
                if path is not None:
                    yield path, "\n".join(lines), owner
                path, lines, last = p, [], None
                owner = columns[4][k] if project else None
            start, chunk = columns[1][k], columns[2][k]
            if chunk is not None and (start, chunk) == last:
                continue
            last = (start, chunk)
            first, content = max(start, 1) - 1, columns[3][k]
            have = len(lines)
            if first + content.count("\n") + 1 <= have:
                continue
            if first > have:
                lines.extend([""] * (first - have))
                have = first
            new = content.split("\n")
            lines.extend(new[have - first :] if have > first else new)
    if path is not None:
        yield path, "\n".join(lines), owner
