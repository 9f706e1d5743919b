"""Merging overlapping hits of several engines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.schemas import as_hits

#: Tie-break of hits with equal lines: the order in which the engines' lists are joined.
ORDER = {"grep": 0, "semantic": 1, "ast": 2}


def union_hits(*engines: DataFrame) -> DataFrame:
    """All hits of the engines in one list, with ``ord`` as their position's major key."""
    return reduce(DataFrame.unionByName, [as_hits(h).withColumn("ord", F.lit(k)) for k, h in enumerate(engines)])


def islands(hits: DataFrame, overlap_lines: int = 3) -> DataFrame:
    """Adds ``island``: a new one starts where a hit begins more than overlap_lines behind the end of all before it.

    One sort per (query, file); no self-join. Equal to the greedy merge of hits sorted by start and end line.
    """
    key = ["query_id", "file_path"]
    order = Window.partitionBy(*key).orderBy("start_line", "end_line", "ord", "preview", "score")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("start_line") > F.max("end_line").over(before) + overlap_lines, 1).otherwise(0)
    return hits.withColumn("fresh", start).withColumn("island", F.sum("fresh").over(order)).withColumn("pos", F.row_number().over(order)).drop("fresh")


def merge_hits(*engines: DataFrame, overlap_lines: int = 3) -> DataFrame:
    """Hits of one file within overlap_lines of each other become one; hits without a neighbour pass untouched.

    Rows need ``file_path`` and lines; null scores count as 0. Works for many queries at once (query_id). Empty inputs
    give no rows.
    """
    return merge_ordered(union_hits(*engines), overlap_lines)


def merge_ordered(hits: DataFrame, overlap_lines: int = 3) -> DataFrame:
    """merge_hits over one frame of hits with ``ord``, for engines whose hits come from one scan."""
    for name in ("grep_score", "semantic_score", "ast_score", "semantic_raw_score", "semantic_norm_score", "last_modified"):
        hits = hits.withColumn(name, F.coalesce(name, F.lit(0.0)))
    hits = hits.withColumn("preview", F.coalesce("preview", F.lit("")))
    marked = islands(hits, overlap_lines)
    ast, sem = F.col("ast_score"), F.col("semantic_score")
    # what the pairwise rule keeps: best AST, else best semantic, else the longest; earlier rows win ties
    rank = F.struct(
        ast.alias("a"), F.when(ast == 0, sem).otherwise(0.0).alias("s"), F.when((ast == 0) & (sem == 0), F.length("preview")).otherwise(0).alias("n"), (-F.col("pos")).alias("p")
    )
    first_ast = F.struct(F.when(ast > 0, 1).otherwise(0).alias("has"), (-F.col("pos")).alias("p"))
    by_pos = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("v")))), lambda s: s["v"])
    hits_of = lambda kind: F.max(F.when(F.col(f"{kind}_score") > 0, 1).otherwise(0))
    merged = marked.groupBy("query_id", "file_path", "island").agg(
        F.count("*").alias("n"),
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        *[F.max(c).alias(c) for c in ("grep_score", "semantic_score", "semantic_raw_score", "semantic_norm_score", "ast_score", "last_modified")],
        F.max_by("preview", rank).alias("preview"),
        F.max_by(F.struct("start_col", "end_col", "ast_score"), first_ast).alias("cols"),
        F.min_by("source", "pos").alias("one_source"),
        F.min_by("symbols", "pos").alias("one_symbols"),
        F.min_by("score", "pos").alias("one_score"),
        F.flatten(F.collect_list(F.coalesce("symbols", F.expr("cast(array() as array<string>)")))).alias("all_symbols"),
        by_pos("language").alias("languages"),
        by_pos("ast_pattern").alias("patterns"),
        by_pos("ast_rule").alias("rules"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.map_entries("ast_captures").alias("v")))), lambda s: F.coalesce(s["v"], F.expr("cast(array() as array<struct<key:string,value:string>>)")))).alias("captures"),
        hits_of("ast").alias("has_ast"),
        hits_of("grep").alias("has_grep"),
        hits_of("semantic").alias("has_semantic"),
    )
    single = F.col("n") == 1
    engines_n = F.col("has_ast") + F.col("has_grep") + F.col("has_semantic")
    source = F.when(engines_n >= 2, "hybrid").when(F.col("has_ast") == 1, "ast").when(F.col("has_grep") == 1, "grep").when(F.col("has_semantic") == 1, "semantic").otherwise("grep")
    # of equal capture names the later value stands
    captures = F.aggregate(
        F.col("captures"), F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))
    )
    out = merged.select(
        "query_id", "file_path", "start_line", "end_line", "preview", "grep_score", "semantic_score", "semantic_raw_score", "semantic_norm_score", "ast_score", "last_modified",
        F.when(single, F.col("one_source")).otherwise(source).alias("source"),
        F.when(single, F.col("one_symbols")).otherwise(F.array_sort(F.array_distinct("all_symbols"))).alias("symbols"),
        F.when(single, F.col("one_score")).otherwise(0.0).alias("score"),
        F.try_element_at(F.filter("languages", lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1)).alias("language"),
        F.try_element_at(F.filter("patterns", lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1)).alias("ast_pattern"),
        F.try_element_at(F.filter("rules", lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1)).alias("ast_rule"),
        captures.alias("ast_captures"),
        F.when(single | (F.col("cols.ast_score") > 0), F.col("cols.start_col")).alias("start_col"),
        F.when(single | (F.col("cols.ast_score") > 0), F.col("cols.end_col")).alias("end_col"),
    )
    return as_hits(out)
