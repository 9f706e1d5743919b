"""Row types of the engine (D1-D24 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: D6, the one row type that every search engine returns and ranking consumes.
HIT = (
    "query_id bigint, source string, file_path string, start_line int, end_line int, score double, preview string, symbols array<string>, grep_score double, semantic_score double, "
    "semantic_raw_score double, semantic_norm_score double, ast_score double, ast_pattern string, ast_rule string, ast_captures map<string,string>, start_col int, end_col int, language string, "
    "last_modified double, symbol_boost double, lexical_boost double, recency_boost double, language_boost double, user_affinity_boost double, context_boost double, graph_boost double"
)
#: D3
CHUNK = (
    "chunk_id string, file_path string, start_line int, end_line int, content string, symbols array<string>, language string, last_modified double, parent_symbol string, chunk_type string, "
    "docstring string, imports array<string>, calls array<string>, inherits array<string>"
)
#: D1
MANIFEST = "path string, mtime double, size bigint, content_hash string"
#: The features that feedback rows carry and the learned ranking model reads.
FEATURES = (
    "grep_score", "semantic_score", "ast_score", "symbol_boost", "lexical_boost", "recency_boost", "language_boost", "user_affinity_boost", "context_boost", "graph_boost",
)
#: D15
FEEDBACK = f"query string, results array<struct<file_path:string,start_line:int,end_line:int,{','.join(f + ':double' for f in FEATURES)}>>, selected_idx int, logged_at double"


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a DDL schema."""
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl)]


def as_hits(df: DataFrame, *keep: str) -> DataFrame:
    """The frame with exactly the hit columns, and those to keep: what is missing gets its neutral value, what is more goes."""
    out = []
    for name, kind in fields(HIT):
        if name in df.columns:
            out.append(F.col(name).cast(kind).alias(name))
        elif kind == "double":
            out.append(F.lit(0.0).alias(name))
        elif name == "symbols":
            out.append(F.expr("cast(array() as array<string>)").alias(name))
        elif name == "ast_captures":
            out.append(F.expr("cast(map() as map<string,string>)").alias(name))
        elif name == "query_id":
            out.append(F.lit(0).cast("bigint").alias(name))
        else:
            out.append(F.lit(None).cast(kind).alias(name))
    return df.select(*out, *keep)
