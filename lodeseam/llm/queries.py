"""The pN_ queries: every operator of this subpackage over its whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.docpairs import file_pairs
from lodeseam.llm.leaks import find_leaks, remove_leaks
from lodeseam.llm.neighbours import nearest_vectors, neighbour_pairs
from lodeseam.llm.packing import pack_documents
from lodeseam.llm.parsing import failure_rates, file_syntax
from lodeseam.llm.provenance import file_provenance, provenance
from lodeseam.llm.reading import reading_levels
from lodeseam.llm.splitting import split_oversized
from lodeseam.sources.assembly import map_files

#: Java parameter lists of the tables end in a comma in half of the files, and the tables' own structural chunker
#: takes those files as parsing; the operator's default is the compilers' strict reading.
JAVA_TRAILING_COMMA = True


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that were too large, from the pieces the splitter made of them."""
    return split_oversized(_table(spark, sf_dir, "code_chunks")).filter("piece = 0 and chunk_id is not null").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_table(spark, sf_dir, "code_chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_provenance(_table(spark, sf_dir, "code_chunks")).filter("provenance is not null").select("file_path")


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per project and provenance; hand-written ones under 'hand-written'."""
    return file_provenance(_table(spark, sf_dir, "code_chunks")).groupBy("project", F.coalesce("provenance", F.lit("hand-written")).alias("provenance")).count()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_syntax(_table(spark, sf_dir, "code_chunks"), JAVA_TRAILING_COMMA).filter("not parses").select("file_path")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_rates(file_syntax(_table(spark, sf_dir, "code_chunks"), JAVA_TRAILING_COMMA))


def documented_functions(chunks: DataFrame, java_trailing_comma: bool = False) -> DataFrame:
    """(file_path, project, symbol, decl_line, end_line, docstring, content) of the documented functions of all hand-written files that parse.

    Provenance, syntax and extraction are decided in one pass over each file, so its text is put together and moved
    once. Functions whose description is empty or trivial are dropped. An empty table gives no rows.
    """

    def run(path: str, text: str, project: str | None):
        if provenance(path, text, project) is None:
            for p in file_pairs(path, text, java_trailing_comma) or ():
                yield path, project, p.symbol, p.decl_line, p.end_line, p.docstring, p.content

    return map_files(chunks, run, "file_path string, project string, symbol string, decl_line int, end_line int, docstring string, content string", project=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(_table(spark, sf_dir, "code_chunks"), JAVA_TRAILING_COMMA).select("file_path", "symbol", "decl_line").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(_table(spark, sf_dir, "code_chunks"), JAVA_TRAILING_COMMA)


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(_table(spark, sf_dir, "embedding_cache"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(p5_neighbours(spark, sf_dir))


#: The public tokenizer in whose tokens documents are measured.
VOCABULARY = os.environ.get("LODESEAM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY)


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "level_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).select("doc_id", "reading_level").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_files, p3_found, p3_rates, p4_found, p4_pairs, p5_found, p5_neighbours, p6_containers, p7_found, p7_leaks, p7_cleaned, p8_found, p8_levels)}

_USABLE = (
    "(SELECT model, text_hash, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY model, text_hash ORDER BY created_at DESC NULLS LAST, embedding DESC) AS rn FROM embedding_cache WHERE model IS NOT NULL AND text_hash IS NOT NULL AND embedding IS NOT NULL"
    " AND len(embedding) = CASE model WHEN 'mesh-embed-base' THEN 96 WHEN 'mesh-embed-large' THEN 128 WHEN 'mesh-embed-mini' THEN 64 END AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE rn = 1)"
)

ORACLES: dict[str, str] = {
    "p5_found": f"SELECT DISTINCT model, least(a, b) AS hash_a, greatest(a, b) AS hash_b FROM (SELECT x.model, x.text_hash AS a, y.text_hash AS b, row_number() OVER (PARTITION BY x.model, x.text_hash ORDER BY round(list_cosine_similarity(x.v, y.v), 14) DESC, y.text_hash) AS place FROM {_USABLE} x JOIN {_USABLE} y ON x.model = y.model AND x.text_hash <> y.text_hash) WHERE place <= 5",
    "p1_found": "SELECT chunk_id FROM code_chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING length(arg_max(content, indexed_at)) > 2000",
}
