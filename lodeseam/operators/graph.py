"""The graph of symbols and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_nodes(chunks: DataFrame) -> DataFrame:
    """(id, symbol, file_path, node_type), one row per id: the files and the symbols of their chunks."""
    files = chunks.filter("file_path is not null").select("file_path").distinct().select(F.col("file_path").alias("symbol"), "file_path", F.lit("file").alias("node_type"))
    kind = F.when(F.coalesce("chunk_type", F.lit("")) == "", "symbol").otherwise(F.col("chunk_type"))
    symbols = chunks.filter("file_path is not null").select(F.explode("symbols").alias("symbol"), "file_path", kind.alias("node_type")).filter("symbol is not null").distinct()
    return files.unionByName(symbols).select(F.md5(F.concat_ws("|", "file_path", "symbol", "node_type")).alias("id"), "symbol", "file_path", "node_type")


def graph_edges(chunks: DataFrame) -> DataFrame:
    """(source, target, edge_type, source_file) of imports, calls and base classes, repeats kept.

    A file's imports come from the file; calls from the chunk's first symbol, else the file; base classes only where
    the chunk has a symbol.
    """
    first = F.try_element_at("symbols", F.lit(1))
    base = chunks.filter("file_path is not null")
    imported = base.select(F.col("file_path").alias("source"), F.explode("imports").alias("target"), F.lit("import").alias("edge_type"), F.col("file_path").alias("source_file"))
    calls = base.select(F.coalesce(first, "file_path").alias("source"), F.explode("calls").alias("target"), F.lit("call").alias("edge_type"), F.col("file_path").alias("source_file"))
    bases = base.filter(first.isNotNull()).select(first.alias("source"), F.explode("inherits").alias("target"), F.lit("inherits").alias("edge_type"), F.col("file_path").alias("source_file"))
    return imported.unionByName(calls).unionByName(bases).filter("target is not null")


def lookup(edges: DataFrame, edge_type: str, targets: DataFrame, column: str = "symbol") -> DataFrame:
    """The distinct sources of edges of a type into each wanted target; an equi-join for many at once."""
    return edges.filter(F.col("edge_type") == edge_type).join(targets.select(F.col(column).alias("target")).distinct(), "target").select("target", "source", "source_file").distinct()


def callers_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return lookup(edges, "call", symbols)


def implementations_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return lookup(edges, "inherits", symbols)


def imports_of(edges: DataFrame, files: DataFrame) -> DataFrame:
    """J4"""
    return edges.filter("edge_type = 'import'").join(files.select(F.col("file_path").alias("source_file")).distinct(), "source_file").select("source_file", "target").distinct()


def without_files(graph: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """K6: the rows of a graph table that belong to none of the files."""
    return graph.join(files.select(F.col("file_path").alias(column)).distinct(), column, "left_anti")


def call_chain(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(start, symbol, depth): what is reached over calls in at most ``depth`` steps, each symbol at its least depth."""
    calls = edges.filter("edge_type = 'call'").select("source", "target").distinct()
    reached = start.select(F.col("symbol").alias("start"), "symbol", F.lit(0).alias("depth")).distinct()
    frontier = reached
    for d in range(1, depth + 1):
        frontier = (
            frontier.join(calls, F.col("symbol") == F.col("source"))
            .select("start", F.col("target").alias("symbol"), F.lit(d).alias("depth"))
            .distinct()
            .join(reached.select("start", "symbol"), ["start", "symbol"], "left_anti")
        )
        reached = reached.unionByName(frontier)
    return reached
