"""The engine's queries over the test tables, each with the SQL that checks it where SQL can say it.

Names in brackets are the operators of the survey that a query covers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseam.engine import Engine
from lodeseam.functions import text as tx
from lodeseam.functions import vectors as vx
from lodeseam.operators import chunking, diversity, embedding, feedback, graph, incremental, merge, ranking, search, structural
from lodeseam.plans import planner
from lodeseam.schemas import as_hits
from lodeseam.sources import assembly, corpus
from lodeseam.streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROOT = "/srv/checkouts"
IGNORED = ("*.min.js", "/quillmesh/units/", "tests/", "src/core/*.py", "dist_*/")
NOW = 1_750_000_000.0
TERMS = ("index", "cache", "search")
QUERY = "where do we load the window cache"
WEIGHTS = {"intercept": -1.2, "grep_score": 0.8, "semantic_score": 1.1, "ast_score": 0.4, "symbol_boost": 2.0, "lexical_boost": 1.5, "recency_boost": 0.7, "user_affinity_boost": 3.0}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: the path is source/id."""
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), "doc_id").alias("file_path"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_chunks without repeated rows; the shuffle moves the key's columns only where others are not asked for."""
    return table(spark, sf_dir, "code_chunks").dropDuplicates(["chunk_id"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files put together from code_chunks, in one streamed pass."""
    rows = assembly.map_files(table(spark, sf_dir, "code_chunks"), lambda path, text, project: [(path, text)], "file_path string, content string")
    return rows.withColumn("language", tx.language_for_path(F.col("file_path")))


_FILES = "(SELECT concat_ws('/', coalesce(source, 'none'), doc_id::VARCHAR) AS file_path, text AS content FROM documents)"
_LINES = f"(SELECT file_path, n AS line_no, rtrim(lines[n], chr(13)) AS line FROM (SELECT file_path, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT file_path, string_split(content, chr(10)) AS lines FROM {_FILES})))"
_CHUNKS = "(SELECT * FROM code_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at) = 1)"
_EVENTS = "(SELECT * FROM search_feedback QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY logged_at DESC) = 1)"
_RESULTS = f"(SELECT search_id, query, logged_at, i - 1 AS idx, results[i] AS r, CASE WHEN selected_idx = i - 1 THEN 1 ELSE 0 END AS selected FROM (SELECT *, unnest(range(1, len(results) + 1)) AS i FROM {_EVENTS}))"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _terms(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains({_list(tx.SEARCH_STOPWORDS)}, w))"


def _language(column: str) -> str:
    ext = f"lower(regexp_extract(regexp_extract({column}, '[^/]*$'), '[^.]\\.([^.]+)$', 1))"
    return f"coalesce(map({_list(tx.LANGUAGES)}, {_list(tx.LANGUAGES.values())})[{ext}], {ext})"


# --------------------------------------------------------------------------- line search


@query(f"SELECT file_path, line_no::INT AS line_no, line FROM {_LINES} WHERE contains(line, 'index')")
def exact_lines(spark, sf_dir):
    """[S7, F1, D2, D7] every line with a literal."""
    return search.grep(doc_files(spark, sf_dir), "index", fixed=True)


@query(f"SELECT file_path, line_no::INT AS line_no, line FROM {_LINES} WHERE regexp_matches(line, '(?i)(^|[^\\p{{L}}])(index|cache)[a-z]*([^\\p{{L}}]|$)')")
def exact_regex_ci(spark, sf_dir):
    """[S7, F2, F3] every line that a pattern matches in either case."""
    return search.grep(doc_files(spark, sf_dir), r"(^|[^\p{L}])(index|cache)[a-z]*([^\p{L}]|$)", ignore_case=True)


@query(f"SELECT file_path, line_no::INT AS line_no, line FROM {_LINES} WHERE regexp_matches(line, 'index[a-z]* +[a-z]+')")
def exact_regex(spark, sf_dir):
    """every line that a case-sensitive pattern matches; a text that the pattern requires is tested on whole files first."""
    return search.grep(doc_files(spark, sf_dir), "index[a-z]* +[a-z]+")


@query(f"SELECT DISTINCT path, {_language('path')} AS language FROM file_manifest WHERE {_language('path')} IN ('python', 'typescript', 'go')")
def language_filter(spark, sf_dir):
    """[F4, P15] the files of the languages asked for."""
    paths = table(spark, sf_dir, "file_manifest").select("path").distinct()
    return paths.withColumn("language", tx.language_for_path(F.col("path"))).filter(F.col("language").isin("python", "typescript", "go"))


@query(
    f"SELECT file_path, line_no::INT AS line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM {_LINES} WHERE contains(line, 'the ')) WHERE rn <= 3 ORDER BY file_path, line_no LIMIT 500"
)
def exact_limit_per_file(spark, sf_dir):
    """[S8, W2, T4] three lines of a file, 500 in all: the limits are the feature."""
    return search.limit_per_file(search.grep(doc_files(spark, sf_dir), "the ", fixed=True), 3, 500)


@query(f"SELECT file_path, count(*) AS matches, min(line_no)::INT AS first_line FROM {_LINES} WHERE contains(line, 'file') GROUP BY file_path")
def exact_counts_by_file(spark, sf_dir):
    """[A1, A2, A10]"""
    return search.counts_by_file(search.grep(doc_files(spark, sf_dir), "file", fixed=True))


@query(f"SELECT file_path, line_no::INT AS line_no, line FROM {_LINES} WHERE line_no BETWEEN 5 AND 30")
def read_range(spark, sf_dir):
    """[S9, S17] the same range of every file."""
    return search.read_lines(search.lines_of(doc_files(spark, sf_dir)), 5, 30)


@query(
    "SELECT file_path, occurrences::INT AS occurrences, round(least(1.0, CASE WHEN occurrences > 0 THEN least(0.7, 0.3 + 0.4 * ln(1.0 + occurrences) / ln(10.0)) ELSE 0 END"
    " + CASE WHEN contains(lower(regexp_extract(file_path, '[^/]*$')), 'index') OR contains(lower(regexp_extract(file_path, '[^/]*$')), 'cache') OR contains(lower(regexp_extract(file_path, '[^/]*$')), 'search') THEN 0.2 ELSE 0 END"
    " + CASE WHEN occurrences > 0 THEN least(0.1, occurrences / lines * 0.05) ELSE 0 END), 6) AS relevance FROM (SELECT file_path, len(string_split(content, chr(10))) AS lines, "
    + " + ".join(f"(length(lower(content)) - length(replace(lower(content), '{t}', ''))) // {len(t)}" for t in TERMS)
    + f" AS occurrences FROM {_FILES})"
)
def grep_relevance(spark, sf_dir):
    """[X1, A9] the relevance of every file for three terms."""
    df = doc_files(spark, sf_dir)
    content = F.col("content")
    return df.select(
        "file_path",
        sum((tx.occurrences(F.lower(content), F.lit(t)) for t in TERMS), F.lit(0)).alias("occurrences"),
        F.round(tx.grep_relevance(content, F.col("file_path"), list(TERMS), F.size(F.split(content, "\n"))), 6).alias("relevance"),
    )


@query()
def grep_hits(spark, sf_dir):
    """[P18, P19, P20, P8, D6] matching lines of all source files with the blocks around them, as scored hits."""
    source = files(spark, sf_dir)
    hits = chunking.matches_to_hits(search.grep(source, "cache", fixed=True), source)
    return hits.withColumn("symbols", tx.python_symbols(F.col("preview"))).withColumn("grep_score", tx.grep_relevance(F.col("preview"), F.col("file_path"), ["cache"], F.col("end_line") - F.col("start_line") + 1))


_INDENT = "(length({0}) - length(regexp_replace({0}, '^[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+', '')))"
_HEAD = "regexp_matches({0}, '^\\s*(async def|def|class)\\s+[\\p{{L}}\\p{{N}}_]')"


@query(
    f"WITH f AS (SELECT file_path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {_FILES} WHERE contains(content, 'return')), m AS (SELECT file_path, l, unnest(list_filter(range(1, len(l) + 1), lambda i: contains(l[i], 'return'))) AS n FROM f),"
    f" k AS (SELECT *, list_max(list_filter(range(1, n + 1), lambda i: {_HEAD.format('l[i]')} AND (i = n OR {_INDENT.format('l[i]')} <= {_INDENT.format('l[n]')}))) AS k FROM m),"
    f" e AS (SELECT *, CASE WHEN k IS NULL THEN greatest(1, n - 15) ELSE k END AS first, CASE WHEN k IS NULL THEN least(len(l), n + 15) ELSE coalesce(list_min(list_filter(range(n + 1, len(l) + 1), lambda j: {_INDENT.format('l[j]')} < length(l[j]) AND NOT regexp_matches(l[j], '^\\s*#') AND {_INDENT.format('l[j]')} <= {_INDENT.format('l[k]')})) - 1, len(l)) END AS last FROM k)"
    " SELECT file_path, n::INT AS line_no, first::INT AS start_line, last::INT AS end_line, CASE WHEN k IS NULL THEN 'file' WHEN regexp_matches(l[k], '^\\s*class') THEN 'class' ELSE 'function' END AS block_type, CASE WHEN k IS NOT NULL THEN regexp_extract(l[k], '^\\s*(?:async def|def|class)\\s+([\\p{L}\\p{N}_]+)', 1) END AS block_name, md5(array_to_string(l[first:last], chr(10))) AS preview_hash FROM e"
)
def document_blocks(spark, sf_dir):
    """[P18, P19, P20] the block around every line of the documents that holds a word."""
    source = doc_files(spark, sf_dir)
    hits = chunking.matches_to_hits(search.grep(source, "return", fixed=True), source)
    return hits.select("file_path", "line_no", "start_line", "end_line", "block_type", "block_name", F.md5("preview").alias("preview_hash"))


# --------------------------------------------------------------------------- corpus


@query(
    f"SELECT DISTINCT path FROM file_manifest WHERE list_contains({_list(corpus.EXTENSIONS)}, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.]\\.([^.]+)$', 1)))"
    f" AND NOT list_contains({_list(corpus.LOCKFILES)}, regexp_extract(path, '[^/]*$')) AND NOT len(list_filter(string_split(regexp_replace(substr(path, 16), '/?[^/]*$', ''), '/'), lambda d: list_contains({_list(corpus.SKIPPED_DIRS)}, d) OR starts_with(d, '.'))) > 0"
    " AND NOT regexp_matches(substr(path, 16), '^.*\\.min\\.js$') AND NOT starts_with(substr(path, 16), 'quillmesh/units/') AND NOT regexp_matches(substr(path, 16), '(^|/)tests/.') AND NOT regexp_matches(substr(path, 16), '(^|/)src/core/.*\\.py$')"
    " AND NOT regexp_matches(substr(path, 16), '(^|/)dist_[^/]*/.')"
)
def indexable_files(spark, sf_dir):
    """[S1-S5, M6] the files that a walk with ignore patterns yields."""
    paths = table(spark, sf_dir, "file_manifest").select("path").distinct()
    return paths.filter(corpus.is_indexable(F.col("path"), list(IGNORED), ROOT))


@query("SELECT concat_ws('/', coalesce(source, 'none'), doc_id::VARCHAR) AS path, epoch(created_at)::DOUBLE AS mtime, strlen(text)::BIGINT AS size, md5(encode(text)[1:8192] || encode(strlen(text)::VARCHAR)) AS content_hash FROM documents")
def file_metadata(spark, sf_dir):
    """[S6, K8, X21] the manifest of the documents."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), "doc_id")
    return docs.select(*corpus.metadata(path, F.col("text"), F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6, sampled=True))


def manifests(spark, sf_dir):
    """(now, before): the latest row of each path, and the earliest of those rows that have a hash."""
    rows = table(spark, sf_dir, "file_manifest").filter("path is not null")
    before = rows.filter("coalesce(content_hash, '') <> ''").groupBy("path").agg(F.min(F.struct("mtime", "size", "content_hash")).alias("row")).select("path", "row.*")
    return incremental.latest(rows, ["path"], "mtime"), before


@query(
    "WITH now AS (SELECT path, max_by({'m': mtime, 's': size, 'h': content_hash}, (mtime IS NOT NULL, mtime, size, content_hash IS NOT NULL, content_hash)) AS r FROM (SELECT path, mtime, size, content_hash, {'a': coalesce(mtime, -1), 'b': size, 'c': coalesce(content_hash, '')} AS o FROM file_manifest WHERE path IS NOT NULL) GROUP BY path),"
    " old AS (SELECT path, min_by({'m': mtime, 's': size, 'h': content_hash}, {'a': coalesce(mtime, -1), 'b': size, 'c': content_hash}) AS r FROM file_manifest WHERE path IS NOT NULL AND coalesce(content_hash, '') <> '' GROUP BY path)"
    " SELECT * FROM (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.r.m IS DISTINCT FROM o.r.m OR n.r.s IS DISTINCT FROM o.r.s OR n.r.h IS DISTINCT FROM o.r.h THEN 'modified' END AS change FROM now n FULL JOIN old o ON n.path = o.path) WHERE change IS NOT NULL"
)
def changed_files(spark, sf_dir):
    """[J6, U2] what changed between two states of the manifest."""
    return incremental.changed_files(*manifests(spark, sf_dir))


@query(f"SELECT coalesce(project, '?') AS project, count(*) AS chunks, count(DISTINCT file_path) AS files, max(last_modified) AS last_modified, sum(length(content))::BIGINT AS characters FROM {_CHUNKS} GROUP BY 1")
def index_stats(spark, sf_dir):
    """[A5, S10, X29]"""
    return incremental.index_stats(chunks(spark, sf_dir).withColumn("project", F.coalesce("project", F.lit("?"))), "project")


@query(
    "SELECT dir, name, is_dir, count(*) AS files FROM (SELECT '/' || array_to_string(parts[1:n - 1], '/') AS dir, parts[n] AS name, n < len(parts) AS is_dir FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS n FROM"
    " (SELECT list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM (SELECT DISTINCT path FROM file_manifest WHERE path IS NOT NULL)))) GROUP BY ALL"
)
def directory_tree(spark, sf_dir):
    """[S16, A11, T7, D23]"""
    return corpus.tree(table(spark, sf_dir, "file_manifest"))


# --------------------------------------------------------------------------- queries as text


@query(f"SELECT query, {_terms('query')} AS terms FROM {_EVENTS}")
def search_terms(spark, sf_dir):
    """[X11]"""
    return feedback.searches(table(spark, sf_dir, "search_feedback")).select("query", tx.search_terms(F.col("query")).alias("terms"))


_Q = f"(SELECT search_id, trim(coalesce(query, '')) AS q FROM {_EVENTS})"
_SHAPES = f"regexp_matches(q, '{tx.CAMEL}') OR regexp_matches(q, '{tx.SNAKE}') OR regexp_matches(q, '{tx.DOTTED}')"
_META = tx.REGEX_META.replace("'", "''")


@query(
    "SELECT search_id, CASE WHEN n = 0 OR i = greatest(i, l, p) THEN 'identifier' WHEN l = greatest(i, l, p) THEN 'natural_language' ELSE 'pattern' END AS query_type,"
    " round((CASE WHEN n = 0 THEN 0.5 ELSE greatest(0.2, least(1.0, greatest(i, l, p))) END)::DOUBLE, 6) AS confidence, n::INT AS word_count, round(camel, 6) AS camel_ratio, round(stop, 6) AS stop_ratio, natural_language FROM ("
    "SELECT *, CASE WHEN q <> '' AND (shaped OR (n <= 2 AND len(list_filter(w, lambda x: length(x) >= 3)) > 0)) THEN 0.6 ELSE 0 END + CASE WHEN camel >= 0.4 THEN 0.3 ELSE 0 END AS i,"
    " CASE WHEN n >= 4 OR stop >= 0.3 THEN 0.6 ELSE 0 END + CASE WHEN n >= 6 THEN 0.2 ELSE 0 END AS l, CASE WHEN regex THEN 0.7 ELSE 0 END AS p FROM ("
    f"SELECT *, len(w) AS n, coalesce(len(list_filter(w, lambda x: regexp_matches(x, '{tx.CAMEL}'))) / nullif(len(w), 0), 0) AS camel, coalesce(len(list_filter(w, lambda x: list_contains({_list(tx.PROFILE_STOPWORDS)}, lower(x)))) / nullif(len(w), 0), 0) AS stop,"
    f" {_SHAPES} OR regexp_matches(q, '{tx.FILE_EXT}') AS shaped, regexp_matches(q, '{_META}') AS regex, len(s) > 1 AND (len(s) >= 3 OR list_has_any(s, {_list(tx.CUE_WORDS)})) AS natural_language FROM ("
    f"SELECT search_id, q, regexp_extract_all(q, '[A-Za-z0-9_]+') AS w, list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda x: x <> '') AS s FROM {_Q})))"
)
def query_profile(spark, sf_dir):
    """[X18, F8, F9, D9]"""
    df = feedback.searches(table(spark, sf_dir, "search_feedback")).withColumn("p", tx.query_profile(F.col("query")))
    return df.select("search_id", "p.query_type", F.round("p.confidence", 6).alias("confidence"), "p.word_count", F.round("p.camel_ratio", 6).alias("camel_ratio"), F.round("p.stop_ratio", 6).alias("stop_ratio"), tx.is_natural_language(F.col("query")).alias("natural_language"))


_BLEND = "round({0} * (1 - confidence) + CASE query_type WHEN 'identifier' THEN {1} WHEN 'natural_language' THEN {2} WHEN 'pattern' THEN {3} ELSE {0} END * confidence, 6)"


@query(f"SELECT search_id, {_BLEND.format(0.5, 0.2, 0.8, 0.1)} AS semantic, {_BLEND.format(0.3, 0.7, 0.1, 0.8)} AS grep, {_BLEND.format(0.15, 0.3, 0.15, 0.2)} AS ast FROM ({ORACLES['query_profile']})")
def adaptive_weights(spark, sf_dir):
    """[X19, X20, D13] the weights that each logged query is scored with."""
    w = ranking.adapted_weights(F.col("query_type"), F.col("confidence"))
    return query_profile(spark, sf_dir).withColumn("w", w).select("search_id", *[F.round(f"w.{c}", 6).alias(c) for c in ("semantic", "grep", "ast")])


@query(f"SELECT search_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(query, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains({_list(tx.SYMBOL_STOPWORDS)}, w)))) AS terms FROM {_EVENTS}")
def symbol_terms(spark, sf_dir):
    """[X12]"""
    return feedback.searches(table(spark, sf_dir, "search_feedback")).select("search_id", F.array_sort(tx.symbol_terms(F.col("query"))).alias("terms"))


_LONGEST = "CASE WHEN len({0}) = 0 THEN NULL ELSE list_filter({0}, lambda x: length(x) = list_max(list_transform({0}, lambda y: length(y))))[1] END"


@query(
    "SELECT search_id, mode, CASE WHEN mode <> 'semantic' AND q <> '' THEN token END AS grep_pattern, mode <> 'semantic' AND q <> '' AND quotes AS grep_fixed, round(CASE WHEN q = '' THEN 0 WHEN mode = 'hybrid' THEN least(0.9, greatest(0.4, greatest(g, s))) ELSE least(1.0, greatest(g, s)) END::DOUBLE, 6) AS confidence FROM ("
    "SELECT *, CASE WHEN q = '' OR whole OR (regex AND NOT quotes AND NOT nat) OR (g >= 0.9 AND s <= 0.3) THEN 'exact' WHEN s >= 0.7 AND g <= 0.4 THEN 'semantic' ELSE 'hybrid' END AS mode FROM ("
    "SELECT *, CASE WHEN quotes THEN 0.7 ELSE 0 END + CASE WHEN shaped THEN 0.5 ELSE 0 END + CASE WHEN ext THEN 0.3 ELSE 0 END + CASE WHEN regex THEN 0.6 ELSE 0 END AS g, CASE WHEN nat THEN 0.6 ELSE 0 END + CASE WHEN len(w) >= 6 THEN 0.2 ELSE 0 END AS s,"
    f" coalesce(CASE WHEN quotes THEN substr(qu[1], 2, length(qu[1]) - 2) END, nullif(regexp_extract(q, '{tx.CAMEL}'), ''), nullif(regexp_extract(q, '{tx.SNAKE}'), ''), nullif(regexp_extract(q, '{tx.DOTTED}'), ''), {_LONGEST.format('telling')}, {_LONGEST.format('tokens')}) AS token FROM ("
    f"SELECT *, len(qu) > 0 AS quotes, list_filter(tokens, lambda x: NOT list_contains({_list(planner.TOKEN_STOPWORDS)}, lower(x))) AS telling, len(w) >= 4 OR len(list_filter(w, lambda x: list_contains({_list(planner.SEMANTIC_CUES)}, lower(x)))) > 0 AS nat FROM ("
    f"SELECT search_id, q, regexp_extract_all(q, '[A-Za-z0-9_]+') AS w, regexp_extract_all(q, '{tx.QUOTED.replace(chr(39), chr(39) * 2)}') AS qu, list_filter(regexp_extract_all(q, '[A-Za-z0-9_./:-]+'), lambda x: length(x) >= 3) AS tokens, {_SHAPES} AS shaped,"
    f" regexp_matches(q, '{tx.FILE_EXT}') AS ext, regexp_matches(q, '{_META}') AS regex, regexp_full_match(q, '{tx.QUOTED.replace(chr(39), chr(39) * 2)}') AS whole FROM {_Q}))))"
)
def query_plans(spark, sf_dir):
    """[X16, X17, D8, the decision table of the planner] the plan of every logged query."""
    df = feedback.searches(table(spark, sf_dir, "search_feedback")).withColumn("p", planner.plan_columns(F.col("query")))
    return df.select("search_id", "p.mode", "p.grep_pattern", "p.grep_fixed", F.round("p.confidence", 6).alias("confidence"))


@query(
    f"SELECT search_id, CASE WHEN len(s) > 1 AND (len(s) >= 3 OR list_has_any(s, {_list(tx.CUE_WORDS)})) THEN list_filter(v, lambda x, i: list_position(v, x) = i)[1:5] ELSE [query] END AS expansions FROM (SELECT *, list_concat([query],"
    " flatten(list_transform(s, lambda w: list_transform(coalesce(m[w], []::VARCHAR[]), lambda t: replace(low, w, t)))), flatten(list_transform(s, lambda w: list_transform(coalesce(m[w], []::VARCHAR[])[1:2], lambda t: low || ' ' || t)))) AS v FROM ("
    "SELECT search_id, query, lower(query) AS low, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '') AS s, "
    + "map(" + _list(planner.CONCEPTS) + ", [" + ", ".join(_list(v[:3]) for v in planner.CONCEPTS.values()) + "]) AS m"
    + f" FROM {_EVENTS} WHERE query IS NOT NULL))"
)
def query_expansion(spark, sf_dir):
    """[X13, X14, J13, U5, D19, D20]"""
    return feedback.searches(table(spark, sf_dir, "search_feedback")).filter("query is not null").select("search_id", planner.expansions(F.col("query")).alias("expansions"))


# --------------------------------------------------------------------------- vectors


def topk(spark, sf_dir, k: int = 10) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search.vector_search(rows.filter("vec_id % 50 = 0"), rows, k, "vec_id", "vec_id", "embedding")


_TOPK = (
    "(SELECT query_id, row_id, cosine, rank, label FROM (SELECT q.vec_id AS query_id, r.vec_id AS row_id, r.label, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS cosine,"
    " row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) DESC, r.vec_id) AS rank FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id) WHERE rank <= 10)"
)


@query(f"SELECT query_id, row_id, round(cosine, 6) AS cosine, rank::INT AS rank FROM {_TOPK}")
def vector_topk(spark, sf_dir):
    """[T1, T2, X3, S10] exact neighbours of every fiftieth vector."""
    return topk(spark, sf_dir).select("query_id", "row_id", F.round("cosine", 6).alias("cosine"), "rank")


@query(
    f"SELECT query_id, row_id, round(raw, 6) AS score_raw, round(CASE WHEN norm < 0.18 THEN 0 ELSE least(norm, 0.95) END, 6) AS score FROM (SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w < 1e-6 THEN raw ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS norm FROM"
    f" (SELECT query_id, row_id, 1 - (1 - cosine) / 2 AS raw FROM {_TOPK}) WINDOW w AS (PARTITION BY query_id))"
)
def vector_normalized(spark, sf_dir):
    """[X2, W1, A4, F7, T5]"""
    df = topk(spark, sf_dir).withColumn("score_raw", vx.distance_to_score(1 - F.col("cosine")))
    return df.select("query_id", "row_id", F.round("score_raw", 6).alias("score_raw"), F.round(vx.confidence_bounds(vx.min_max(F.col("score_raw"), "query_id")), 6).alias("score"))


@query(
    f"SELECT query_id, row_id, variant::INT AS variant, round(score, 6) AS score FROM (SELECT g AS query_id, row_id, v AS variant, s AS score, row_number() OVER (PARTITION BY g, row_id ORDER BY s DESC, v) AS rn FROM (SELECT query_id - query_id % 150 AS g, row_id, query_id % 150 // 50 AS v, cosine * CASE WHEN query_id % 150 = 0 THEN 1.0 ELSE 0.9 END AS s FROM {_TOPK})) WHERE rn = 1"
)
def multi_query_best(spark, sf_dir):
    """[A3] three neighbouring queries as variants of one."""
    variants = topk(spark, sf_dir).select((F.col("query_id") - F.col("query_id") % 150).alias("query_id"), ((F.col("query_id") % 150) / 50).cast("int").alias("variant"), "row_id", F.col("cosine").alias("score"))
    return search.best_of_variants(variants).select("query_id", "row_id", "variant", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, row_id, label, rn::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS rn FROM {_TOPK}) WHERE rn <= 3")
def vector_cap_per_group(spark, sf_dir):
    """[W2] neighbours, three of a label at most."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    w = Window.partitionBy("query_id", "label").orderBy("rank")
    return topk(spark, sf_dir).join(labels, "row_id").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("query_id", "row_id", "label", "place")


@query(
    f"WITH RECURSIVE c AS MATERIALIZED (SELECT query_id, row_id, rank, cosine, embedding::DOUBLE[] AS v FROM {_TOPK} JOIN (SELECT vec_id, embedding FROM embeddings) ON vec_id = row_id), near AS MATERIALIZED (SELECT a.query_id, a.row_id, a.rank, a.cosine, list(list_cosine_similarity(a.v, b.v) ORDER BY b.rank) AS sims FROM c a JOIN c b ON a.query_id = b.query_id GROUP BY ALL),"
    " walk AS (SELECT DISTINCT query_id, 1 AS step, [1::BIGINT] AS chosen FROM near UNION ALL SELECT query_id, any_value(step) + 1, list_append(any_value(chosen), min_by(rank, {'w': 1 - close < 0.3, 'v': -CASE WHEN 1 - close < 0.3 THEN cosine ELSE 0.7 * cosine - 0.3 * close END, 'r': rank})) FROM"
    " (SELECT w.query_id, w.step, w.chosen, n.rank, n.cosine, list_max(list_transform(w.chosen, lambda x: n.sims[x])) AS close FROM walk w JOIN near n ON n.query_id = w.query_id AND NOT list_contains(w.chosen, n.rank)) GROUP BY query_id)"
    " SELECT query_id, row_id::VARCHAR AS file_path, rank::INT AS rank, list_position(chosen, rank)::INT AS mmr_rank FROM near JOIN (SELECT query_id, max_by(chosen, step) AS chosen FROM walk GROUP BY query_id) USING (query_id)"
)
def vector_mmr(spark, sf_dir):
    """[W5, D14] neighbours in MMR order."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    hits = topk(spark, sf_dir).join(rows, "row_id").select("query_id", F.col("row_id").cast("string").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("cosine").alias("score"), F.col("row_id").cast("string").alias("preview"), "vector")
    return diversity.mmr_rerank(hits).select("query_id", "file_path", "rank", "mmr_rank")


@query(
    "SELECT model, text_hash, created_at, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squared FROM (SELECT *, row_number() OVER (PARTITION BY model, text_hash ORDER BY created_at DESC, embedding DESC) AS rn FROM embedding_cache WHERE embedding IS NOT NULL"
    " AND len(embedding) = CASE model WHEN 'mesh-embed-base' THEN 96 WHEN 'mesh-embed-large' THEN 128 WHEN 'mesh-embed-mini' THEN 64 END AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE rn = 1"
)
def embedding_cache_latest(spark, sf_dir):
    """[K7, F10, D4, S14]"""
    df = incremental.latest_embeddings(table(spark, sf_dir, "embedding_cache"))
    return df.select("model", "text_hash", "created_at", F.round(vx.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"))


@query("SELECT model, hit, count(*) AS texts FROM (SELECT m.model, m.text_hash, EXISTS (SELECT 1 FROM embedding_cache c WHERE c.model = 'mesh-embed-base' AND c.text_hash = m.text_hash) AS hit FROM (SELECT DISTINCT model, text_hash FROM embedding_cache) m) GROUP BY ALL")
def embedding_cache_lookup(spark, sf_dir):
    """[J11] which of all models' texts the base model has embedded."""
    cache = table(spark, sf_dir, "embedding_cache")
    base = cache.filter("model = 'mesh-embed-base'").select("text_hash", F.lit("mesh-embed-base").alias("model"), "embedding").dropDuplicates(["text_hash"])
    wanted = cache.select(F.col("model").alias("of"), "text_hash").distinct().withColumn("model", F.lit("mesh-embed-base"))
    hits, misses = incremental.cache_split(wanted, base)
    both = hits.select("of", F.lit(True).alias("hit")).unionByName(misses.select("of", F.lit(False).alias("hit")))
    return both.groupBy(F.col("of").alias("model"), "hit").agg(F.count("*").alias("texts"))


# --------------------------------------------------------------------------- hits: merge, score, filter


def engine_hits(spark, sf_dir) -> DataFrame:
    """Stand-ins for the hits of the three engines, with scores that SQL can repeat, for the queries that SQL checks; no engine runs, find_hybrid runs them."""
    rows = chunks(spark, sf_dir).filter("file_path is not null and content is not null and start_line is not null").select(
        "file_path", "start_line", (F.col("start_line") + F.size(F.split("content", "\n")) - 1).alias("end_line"), F.col("content").alias("preview"), "symbols", "language", "last_modified", "docstring", "chunk_type"
    )
    n = sum((tx.occurrences(F.lower("preview"), F.lit(t)) for t in ("load", "window")), F.lit(0))
    one = lambda k, name, test, score: F.when(test, F.struct(F.lit(k).alias("ord"), F.lit(name).alias("source"), score.cast("double").alias("score")))
    long = F.length("docstring")
    found = F.array(
        one(0, "grep", n > 0, F.least(F.lit(1.0), n / 10.0)), one(1, "semantic", long > 40, F.least(F.lit(1.0), long / 400.0)), one(2, "ast", F.col("chunk_type") == "class", F.lit(0.9))
    )
    hits = rows.withColumn("e", F.explode(F.array_compact(found)))
    scores = {f"{name}_score": F.when(F.col("e.source") == name, F.col("e.score")).otherwise(0.0) for name in ("grep", "semantic", "ast")}
    return as_hits(hits.withColumns(scores).withColumn("source", F.col("e.source")).withColumn("ord", F.col("e.ord")), "ord")


_HITS = (
    f"(WITH rows AS (SELECT file_path, start_line, start_line + len(string_split(content, chr(10))) - 1 AS end_line, content AS preview, symbols, language, last_modified, docstring, chunk_type FROM {_CHUNKS} WHERE file_path IS NOT NULL AND content IS NOT NULL AND start_line IS NOT NULL),"
    " g AS (SELECT *, least(1.0, ((length(lower(preview)) - length(replace(lower(preview), 'load', ''))) // 4 + (length(lower(preview)) - length(replace(lower(preview), 'window', ''))) // 6) / 10.0)::DOUBLE AS gs FROM rows)"
    " SELECT file_path, start_line, end_line, preview, symbols, language, coalesce(last_modified, 0.0) AS last_modified, gs, 0.0::DOUBLE AS ss, 0.0::DOUBLE AS acs, 0 AS ord FROM g WHERE gs > 0"
    " UNION ALL SELECT file_path, start_line, end_line, preview, symbols, language, coalesce(last_modified, 0.0), 0.0, least(1.0, length(docstring) / 400.0), 0.0, 1 FROM rows WHERE length(docstring) > 40"
    " UNION ALL SELECT file_path, start_line, end_line, preview, symbols, language, coalesce(last_modified, 0.0), 0.0, 0.0, 0.9, 2 FROM rows WHERE chunk_type = 'class')"
)
_MERGED = (
    f"(SELECT file_path, island, count(*) AS n, min(start_line) AS start_line, max(end_line) AS end_line, max(gs) AS grep_score, max(ss) AS semantic_score, max(acs) AS ast_score, max(last_modified) AS last_modified,"
    " max_by(preview, {'a': acs, 's': CASE WHEN acs = 0 THEN ss ELSE 0 END, 'n': CASE WHEN acs = 0 AND ss = 0 THEN length(preview) ELSE 0 END, 'p': -pos}) AS preview,"
    " CASE WHEN count(*) = 1 THEN coalesce(any_value(symbols), []::VARCHAR[]) ELSE list_sort(list_distinct(flatten(list(coalesce(symbols, []::VARCHAR[]))))) END AS symbols, list_filter(list(language ORDER BY pos), lambda x: coalesce(x, '') <> '')[1] AS language,"
    " CASE WHEN (max(gs) > 0)::INT + (max(ss) > 0)::INT + (max(acs) > 0)::INT >= 2 THEN 'hybrid' WHEN max(acs) > 0 THEN 'ast' WHEN max(gs) > 0 THEN 'grep' ELSE 'semantic' END AS source FROM (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY pos) AS island FROM ("
    "SELECT *, row_number() OVER w AS pos, CASE WHEN max(end_line) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AND start_line > max(end_line) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 1 ELSE 0 END AS fresh FROM "
    + _HITS
    + " WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line, ord, preview))) GROUP BY file_path, island)"
)


@query(f"SELECT file_path, start_line::INT AS start_line, end_line::INT AS end_line, source, round(grep_score, 6) AS grep_score, round(semantic_score, 6) AS semantic_score, ast_score, md5(preview) AS preview_hash, symbols FROM {_MERGED}")
def hybrid_merge(spark, sf_dir):
    """[J1, U1, U4, W4, A1] stand-in hits of three engines over all chunks, merged."""
    m = merge.merge_ordered(engine_hits(spark, sf_dir))
    return m.select("file_path", "start_line", "end_line", "source", F.round("grep_score", 6).alias("grep_score"), F.round("semantic_score", 6).alias("semantic_score"), "ast_score", F.md5("preview").alias("preview_hash"), F.coalesce("symbols", F.expr("cast(array() as array<string>)")).alias("symbols"))


_QT = "[" + ", ".join(f"'{t}'" for t in ("load", "window", "cache")) + "]"
_SCORED = (
    f"(SELECT *, CASE WHEN a > 0 AND (g > 0 OR s > 0) THEN least(1.0, 0.5 * s + 0.3 * g + 0.2 + b) WHEN a > 0 THEN least(1.0, 0.7 * a + b) WHEN s > 0 AND g > 0 THEN least(1.0, 0.5 * s + 0.3 * g + 0.08 + b) WHEN s > 0 THEN least(1.0, s + b) WHEN g > 0 THEN least(1.0, g + b) ELSE b END AS score FROM ("
    f"SELECT *, grep_score AS g, semantic_score AS s, ast_score AS a, CASE WHEN len(symbols) > 0 THEN 0.08 * len(list_filter({_QT}, lambda t: contains(lower(array_to_string(symbols, ' ')), t))) / 3 ELSE 0 END + 0.05 * len(list_filter({_QT}, lambda t: contains(lower(preview || ' ' || array_to_string(symbols, ' ')), t))) / 3"
    f" + CASE WHEN last_modified > 0 THEN 0.03 * power(0.5, greatest(0.0, ({NOW} - last_modified) / 86400.0) / 30.0) ELSE 0 END AS b FROM {_MERGED}))"
)


def scored(spark, sf_dir) -> DataFrame:
    return ranking.score_hits(merge.merge_ordered(engine_hits(spark, sf_dir)), F.lit(QUERY), NOW)


@query(f"SELECT file_path, start_line::INT AS start_line, end_line::INT AS end_line, round(score, 6) AS score FROM {_SCORED}")
def hybrid_score(spark, sf_dir):
    """[X4-X7, X9, D13] the score of every merged stand-in hit."""
    return scored(spark, sf_dir).select("file_path", "start_line", "end_line", F.round("score", 6).alias("score"))


@query(
    f"SELECT file_path, start_line::INT AS start_line, end_line::INT AS end_line FROM {_SCORED} WHERE NOT EXISTS (SELECT 1 FROM {_SCORED} x WHERE x.grep_score > 0 OR x.ast_score > 0) OR grep_score > 0 OR ast_score > 0"
)
def precise_filter(spark, sf_dir):
    """[F5]"""
    return ranking.precise(scored(spark, sf_dir)).select("file_path", "start_line", "end_line")


QUERY_TERMS = ("load", "window", "cache")
STRUCTURES = ("class $NAME", "$X.load($$$)")


class TableEngine(Engine):
    """The engine over the test tables: the files put together from code_chunks, the chunks with their rich text embedded as index."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, ROOT, sf_dir)
        self.sf_dir = sf_dir

    def has_index(self) -> bool:
        return True

    def files(self) -> DataFrame:
        return files(self.spark, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, "code_chunks")

    def vectors(self) -> DataFrame:
        return embed_chunks(self.spark, self.sf_dir)

    def _grep(self, plan: planner.QueryPlan, files: DataFrame, query: str, k: int) -> DataFrame:
        """All matching lines, in either case; a block counts once."""
        hits = chunking.line_blocks(search.matching_lines(files, plan.grep_pattern, ignore_case=True), once=True)
        base = search.base_score(len(query.split()), plan.run_semantic, plan.grep_fixed)
        relevance = tx.grep_relevance(F.col("preview"), F.col("file_path"), list(QUERY_TERMS), F.col("end_line") - F.col("start_line") + 1, base)
        return as_hits(hits.withColumn("source", F.lit("grep")).withColumn("symbols", tx.python_symbols(F.col("preview"))).withColumn("grep_score", relevance))


@query()
def find_hybrid(spark, sf_dir):
    """The flagship: line search, vector search and structural search over whole tables, merge, score, MMR, cap per file, the ten best. [T3, W2, W3, W5]"""
    plan = planner.plan_query(QUERY, ast_patterns=STRUCTURES)
    plan = replace(plan, mode="hybrid", run_grep=True, run_semantic=True, grep_pattern="|".join(QUERY_TERMS), semantic_query=plan.semantic_query or QUERY)
    hits = TableEngine(spark, sf_dir).find(QUERY, k=10, ast_top_files=None, ast_max_matches=None, now=NOW, plan=plan)
    return hits.select("rank", "file_path", "start_line", "end_line", "source", F.round("score", 6).alias("score"), tx.truncated(F.element_at(F.split("preview", "\n"), 1)).alias("first_line"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x1c-\\x1f\\x{85}\\x{a0}]+', ' ', 'g'))) ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_preview(spark, sf_dir):
    """[W3] documents without repeats but for white space."""
    docs = table(spark, sf_dir, "documents").withColumn("k", F.md5(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\x0B\x1c-\x1f\x85\xa0]+", " "))))
    w = Window.partitionBy("k").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    return docs.select("doc_id", "n_chars", "k").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("doc_id")


@query(f"SELECT path, mtime, round(CASE WHEN mtime > 0 THEN power(0.5, greatest(0.0, ({NOW} - mtime) / 86400.0) / 30.0) ELSE 0 END, 9) AS recency FROM (SELECT DISTINCT path, mtime FROM file_manifest)")
def recency_decay(spark, sf_dir):
    """[X6]"""
    return table(spark, sf_dir, "file_manifest").select("path", "mtime").distinct().withColumn("recency", F.round(tx.recency(F.col("mtime"), F.lit(NOW)), 9))


_CURRENT = "/srv/checkouts/quillmesh/units/amber00/src/core/detach_file.py"


@query(
    f"SELECT path, CASE WHEN path = '{_CURRENT}' THEN 1.0 WHEN regexp_replace(path, '/?[^/]*$', '') = regexp_replace('{_CURRENT}', '/?[^/]*$', '') THEN 0.6 WHEN regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]+$', '\\1') IN ('queue', 'graph') OR contains(path, 'queue') OR contains(path, 'graph') THEN 0.4 ELSE 0.0 END::DOUBLE AS context FROM (SELECT DISTINCT path FROM file_manifest WHERE path IS NOT NULL)"
)
def context_match(spark, sf_dir):
    """[J8, J9, X23, D18]"""
    return table(spark, sf_dir, "file_manifest").filter("path is not null").select("path").distinct().withColumn("context", ranking.context_match(F.col("path"), _CURRENT, ["core.queue", "./lib/graph"]))


# --------------------------------------------------------------------------- chunks and graph


@query(f"SELECT chunk_id, {_language('file_path')} AS language FROM {_CHUNKS}")
def chunk_languages(spark, sf_dir):
    """[P14, P15]"""
    return chunks(spark, sf_dir).select("chunk_id", tx.language_for_path(F.col("file_path")).alias("language"))


@query(f"SELECT chunk_id, substr(md5(concat_ws(':', file_path, start_line::VARCHAR, content)), 1, 12) AS content_id FROM {_CHUNKS}")
def chunk_ids(spark, sf_dir):
    """[P17, Q18]"""
    return chunks(spark, sf_dir).select("chunk_id", tx.content_hash(F.concat_ws(":", "file_path", "start_line", "content")).alias("content_id"))


@query(f"SELECT chunk_id, list_distinct_ordered AS symbols FROM (SELECT chunk_id, list_filter(s, lambda x, i: list_position(s, x) = i)[1:5] AS list_distinct_ordered FROM (SELECT chunk_id, regexp_extract_all(content, '(?m)^\\s*(?:async\\s+def|def|class)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS s FROM {_CHUNKS}))")
def chunk_symbols(spark, sf_dir):
    """[P7, P8, T6]"""
    return chunks(spark, sf_dir).select("chunk_id", tx.python_symbols(F.col("content")).alias("symbols"))


@query(
    "SELECT chunk_id, CASE language WHEN 'python' THEN list_sort(list_distinct(list_concat(regexp_extract_all(content, '(?m)^\\s*import\\s+([A-Za-z0-9_\\.]+)', 1), regexp_extract_all(content, '(?m)^\\s*from\\s+([A-Za-z0-9_\\.]+)\\s+import', 1))))"
    " WHEN 'javascript' THEN list_sort(list_distinct(list_concat(regexp_extract_all(content, '(?-s)import\\s+.*?from\\s+[\"'']([^\"'']+)[\"'']', 1), regexp_extract_all(content, 'require\\([\"'']([^\"'']+)[\"'']\\)', 1))))"
    " WHEN 'typescript' THEN list_sort(list_distinct(list_concat(regexp_extract_all(content, '(?-s)import\\s+.*?from\\s+[\"'']([^\"'']+)[\"'']', 1), regexp_extract_all(content, 'require\\([\"'']([^\"'']+)[\"'']\\)', 1))))"
    " WHEN 'rust' THEN list_sort(list_distinct(regexp_extract_all(content, '(?m)^\\s*use\\s+([A-Za-z0-9_:]+)', 1))) WHEN 'java' THEN list_sort(list_distinct(regexp_extract_all(content, '(?m)^\\s*import\\s+([A-Za-z0-9_\\.]+)', 1)))"
    f" WHEN 'go' THEN list_sort(list_distinct(regexp_extract_all(content, 'import\\s+\"([^\"]+)\"', 1))) ELSE []::VARCHAR[] END AS imports FROM (SELECT * REPLACE ({_language('file_path')} AS language) FROM {_CHUNKS})"
)
def chunk_imports(spark, sf_dir):
    """[P9]"""
    df = chunks(spark, sf_dir).withColumn("language", tx.language_for_path(F.col("file_path")))
    return df.select("chunk_id", tx.imports(F.col("language"), F.col("content")).alias("imports"))


@query(
    "SELECT chunk_id, md5(array_to_string(list_filter([CASE WHEN coalesce(language, '') <> '' THEN '[LANG=' || language || ']' END, '[FILE=' || CASE WHEN starts_with(file_path, '/srv/checkouts/') THEN substr(file_path, 16) ELSE file_path END || ']', '[LINES=' || start_line || '-' || end_line || ']',"
    " CASE WHEN len(symbols) > 0 AND array_to_string(symbols[1:5], ', ') <> '' THEN '[SYMBOLS=' || array_to_string(symbols[1:5], ', ') || ']' END, CASE WHEN coalesce(parent_symbol, '') <> '' THEN '[PARENT=' || parent_symbol || ']' END, CASE WHEN coalesce(chunk_type, '') <> '' THEN '[TYPE=' || chunk_type || ']' END,"
    " CASE WHEN array_to_string(imports[1:5], ', ') <> '' THEN '[IMPORTS=' || array_to_string(imports[1:5], ', ') || ']' END, CASE WHEN coalesce(doc, '') <> '' THEN '[DOC=' || doc || ']' END], lambda x: x IS NOT NULL), ' ') || chr(10) || coalesce(content, '')) AS rich_hash"
    f" FROM (SELECT *, trim(substr(replace(trim(regexp_replace(docstring, '^\\s+|\\s+$', '', 'g')), chr(10), ' '), 1, 200)) AS doc FROM {_CHUNKS})"
)
def rich_text(spark, sf_dir):
    """[P16] the text that is embedded for every chunk, as a hash."""
    return chunks(spark, sf_dir).select("chunk_id", F.md5(tx.rich_text(ROOT)).alias("rich_hash"))


@query(
    f"SELECT md5(concat_ws('|', file_path, symbol, node_type)) AS id, symbol, file_path, node_type FROM (SELECT DISTINCT file_path AS symbol, file_path, 'file' AS node_type FROM code_chunks WHERE file_path IS NOT NULL UNION SELECT DISTINCT unnest(symbols), file_path, coalesce(nullif(chunk_type, ''), 'symbol') FROM {_CHUNKS} WHERE file_path IS NOT NULL) WHERE symbol IS NOT NULL"
)
def graph_nodes(spark, sf_dir):
    """[J5, K5, D11]"""
    return graph.graph_nodes(chunks(spark, sf_dir))


_EDGES = (
    f"(SELECT file_path AS source, unnest(imports) AS target, 'import' AS edge_type, file_path AS source_file FROM {_CHUNKS} WHERE file_path IS NOT NULL UNION ALL SELECT coalesce(symbols[1], file_path), unnest(calls), 'call', file_path FROM {_CHUNKS} WHERE file_path IS NOT NULL"
    f" UNION ALL SELECT symbols[1], unnest(inherits), 'inherits', file_path FROM {_CHUNKS} WHERE file_path IS NOT NULL AND symbols[1] IS NOT NULL)"
)


@query(f"SELECT source, target, edge_type, source_file FROM {_EDGES} WHERE target IS NOT NULL")
def graph_edges(spark, sf_dir):
    """[J5, K5, D12, Q17]"""
    return graph.graph_edges(chunks(spark, sf_dir))


@query(f"SELECT DISTINCT e.target, e.source, e.source_file FROM {_EDGES} e WHERE edge_type = 'call' AND target IN (SELECT unnest(symbols) FROM code_chunks WHERE chunk_type = 'class')")
def callers_of(spark, sf_dir):
    """[J2] who calls any symbol of a class."""
    rows = chunks(spark, sf_dir)
    return graph.callers_of(graph.graph_edges(rows), rows.filter("chunk_type = 'class'").select(F.explode("symbols").alias("symbol")))


@query(f"SELECT DISTINCT e.target, e.source, e.source_file FROM {_EDGES} e WHERE edge_type = 'inherits' AND target IS NOT NULL")
def implementations_of(spark, sf_dir):
    """[J3] all base classes with what extends them."""
    edges = graph.graph_edges(chunks(spark, sf_dir))
    return graph.implementations_of(edges, edges.filter("edge_type = 'inherits'").select(F.col("target").alias("symbol")))


@query(f"SELECT DISTINCT e.source_file, e.target FROM {_EDGES} e WHERE edge_type = 'import' AND target IS NOT NULL AND source_file IN (SELECT path FROM file_manifest)")
def imports_of_files(spark, sf_dir):
    """[J4]"""
    return graph.imports_of(graph.graph_edges(chunks(spark, sf_dir)), table(spark, sf_dir, "file_manifest").select(F.col("path").alias("file_path")))


@query(
    f"WITH RECURSIVE calls AS MATERIALIZED (SELECT DISTINCT source, target FROM {_EDGES} WHERE edge_type = 'call' AND target IS NOT NULL), reach AS (SELECT DISTINCT target AS start, target AS symbol, 0 AS depth FROM {_EDGES} WHERE edge_type = 'inherits' AND target IS NOT NULL UNION SELECT r.start, c.target, r.depth + 1 FROM reach r JOIN calls c ON r.symbol = c.source WHERE r.depth < 2) SELECT start, symbol, min(depth)::INT AS depth FROM reach GROUP BY start, symbol"
)
def call_chains(spark, sf_dir):
    """[§2.16 call chains] what the base classes reach in two calls."""
    edges = graph.graph_edges(chunks(spark, sf_dir))
    return graph.call_chain(edges, edges.filter("edge_type = 'inherits'").select(F.col("target").alias("symbol")), 2)


@query(
    f"SELECT m.file_path, m.start_line::INT AS start_line, m.end_line::INT AS end_line FROM {_MERGED} m WHERE m.file_path IN (SELECT source_file FROM {_EDGES} WHERE edge_type = 'inherits') OR list_has_any(m.symbols, (SELECT list(DISTINCT source) FROM {_EDGES} WHERE edge_type = 'inherits' AND target IS NOT NULL))"
)
def graph_filter(spark, sf_dir):
    """[F6, J10, J12, U3] merged hits related to classes that extend others."""
    edges = graph.graph_edges(chunks(spark, sf_dir)).filter("edge_type = 'inherits'")
    related = edges.select(F.col("source_file").alias("file_path"), F.col("source").alias("symbol"))
    return ranking.only_related(merge.merge_ordered(engine_hits(spark, sf_dir)), related).select("file_path", "start_line", "end_line")


@query(f"SELECT e.source, e.target, e.edge_type, e.source_file FROM {_EDGES} e WHERE target IS NOT NULL AND source_file NOT IN (SELECT path FROM file_manifest WHERE {_language('path')} = 'python')")
def graph_without_files(spark, sf_dir):
    """[K6, X33] the edges that are left when the Python files of the manifest are taken out."""
    gone = table(spark, sf_dir, "file_manifest").select(F.col("path").alias("file_path")).filter(tx.language_for_path(F.col("file_path")) == "python")
    return graph.without_files(graph.graph_edges(chunks(spark, sf_dir)), gone, "source_file")


@query(
    f"SELECT chunk_id, file_path, CASE WHEN {_language('file_path')} = 'go' THEN 'fresh' ELSE 'kept' END AS state FROM (SELECT DISTINCT chunk_id, file_path FROM code_chunks WHERE file_path IS NOT NULL) WHERE {_language('file_path')} <> 'python'"
)
def index_upsert(spark, sf_dir):
    """[K1, K3, S11, M4] an index after the Python files are deleted and the Go files are chunked anew: rows of changed files go, fresh ones come."""
    index = table(spark, sf_dir, "code_chunks").filter("file_path is not null").select("chunk_id", "file_path").distinct()
    language = tx.language_for_path(F.col("file_path"))
    changes = index.select("file_path").distinct().filter(language.isin("python", "go")).select(F.col("file_path").alias("path"), F.when(language == "go", "modified").otherwise("deleted").alias("change"))
    fresh = index.filter(language == "go").withColumn("state", F.lit("fresh"))
    return incremental.apply_changes(index.withColumn("state", F.lit("kept")), fresh, changes)


@query(
    f"SELECT chunk_id, CASE WHEN len(symbols) % 2 = 0 THEN list_filter(string_split(array_to_string(symbols, ','), ','), lambda x: x <> '') ELSE symbols END AS symbols FROM {_CHUNKS} WHERE symbols IS NOT NULL AND len(list_filter(symbols, lambda x: x IS NULL)) = 0"
)
def stored_lists(spark, sf_dir):
    """[X22] lists read back from JSON text, or from comma lists where the text is none."""
    rows = chunks(spark, sf_dir).filter(F.col("symbols").isNotNull() & ~F.exists("symbols", lambda x: x.isNull()))
    stored = F.when(F.size("symbols") % 2 == 0, F.array_join("symbols", ",")).otherwise(F.to_json("symbols"))
    return rows.select("chunk_id", tx.json_list(stored).alias("symbols"))


@query("SELECT DISTINCT path, strftime(make_timestamp((mtime * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') AS modified_at FROM file_manifest WHERE mtime IS NOT NULL")
def iso_times(spark, sf_dir):
    """[X24]"""
    return table(spark, sf_dir, "file_manifest").filter("mtime is not null").select("path", tx.iso_time(F.col("mtime")).alias("modified_at")).distinct()


@query(
    f"SELECT file_path, start_line::INT AS start_line, (start_line + 2)::INT AS end_line, length(content)::INT AS start_col, 'python' AS language, md5(content) AS preview_hash, chunk_id AS caught, coalesce(array_to_string(symbols, ', '), '') AS caught_all, 0.9::DOUBLE AS ast_score FROM {_CHUNKS} WHERE file_path IS NOT NULL AND content IS NOT NULL AND start_line IS NOT NULL"
)
def match_json(spark, sf_dir):
    """[G3] the hits of structural search tools, read from the JSON they print: zero-based lines, single and multiple captures."""
    rows = chunks(spark, sf_dir).filter("file_path is not null and content is not null and start_line is not null")
    place = lambda line: F.struct(line.cast("int").alias("line"), F.length("content").alias("column"))
    many = F.transform(F.coalesce("symbols", F.expr("cast(array() as array<string>)")), lambda x: F.struct(x.alias("text")))
    one = F.struct(
        F.col("file_path").alias("file"), F.col("content").alias("text"), F.lit("Python").alias("language"), F.struct(place(F.col("start_line") - 1).alias("start"), place(F.col("start_line") + 1).alias("end")).alias("range"),
        F.struct(F.create_map(F.lit("A"), F.struct(F.col("chunk_id").alias("text"))).alias("single"), F.create_map(F.lit("B"), many).alias("multi")).alias("metaVariables"),
    )
    hits = structural.parse_match_json(rows.select(F.to_json(F.array(one)).alias("json")))
    return hits.select("file_path", "start_line", "end_line", "start_col", "language", F.md5("preview").alias("preview_hash"), F.col("ast_captures")["A"].alias("caught"), F.col("ast_captures")["B"].alias("caught_all"), "ast_score")


@query(f"SELECT CASE ord WHEN 0 THEN 'grep' WHEN 1 THEN 'semantic' ELSE 'ast' END AS source, count(*) AS hits, count(DISTINCT file_path) AS files FROM ({_HITS}) GROUP BY ord")
def stage_counts(spark, sf_dir):
    """[A10] what each engine's stand-in hits come to."""
    return ranking.stage_counts(engine_hits(spark, sf_dir))


@query(f"SELECT file_path, round(max(greatest(gs, ss)), 6) AS best FROM ({_HITS}) WHERE ord < 2 GROUP BY file_path ORDER BY max(greatest(gs, ss)) DESC, file_path LIMIT 100")
def narrowed_files(spark, sf_dir):
    """[J12] the hundred files of the best hits, to which a structural search is narrowed: the limit is the feature."""
    return ranking.top_files(engine_hits(spark, sf_dir).filter("source <> 'ast'"), 100).select("file_path", F.round("best", 6).alias("best"))


@query()
def chunk_code(spark, sf_dir):
    """[P1-P5, P9-P13, X33] all source files put together and cut anew."""
    return chunking.chunk_files(files(spark, sf_dir))


_SOLID = "regexp_matches({0}, '[^\\s\\x0B\\x1c-\\x1f\\x{{85}}\\x{{a0}}]')"
_REACH = "least(s.n, greatest({1}, len(list_filter(s.sums, lambda x: x <= s.sums[{0}] + 2000)) - 1))"


@query(
    f"WITH RECURSIVE s AS MATERIALIZED (SELECT *, len(l) AS n, list_prepend(0, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + 1))::BIGINT)) AS sums FROM (SELECT row_number() OVER () AS id, file_path, string_split(t, chr(10)) AS l FROM (SELECT file_path, replace(content, chr(13) || chr(10), chr(10)) AS t FROM {_FILES}) WHERE {_SOLID.format('t')})),"
    f" walk AS (SELECT s.id, 1::BIGINT AS first, {_REACH.format('1', '1')} AS last FROM s UNION ALL SELECT id, first, {_REACH.format('first', 'fresh')} FROM (SELECT w.id AS wid, w.last + 1 AS fresh, w.last + 1 - CASE WHEN w.last - w.first + 1 > 3 THEN 3 ELSE 0 END AS first FROM walk w) JOIN s ON s.id = wid AND fresh <= s.n)"
    f" SELECT left(md5(file_path || ':' || first || ':' || content), 12) AS chunk_id, file_path, first::INT AS start_line, last::INT AS end_line, content FROM (SELECT s.file_path, w.first, w.last, array_to_string(s.l[w.first:w.last], chr(10)) AS content FROM walk w JOIN s USING (id)) WHERE {_SOLID.format('content')}"
)
def chunk_documents(spark, sf_dir):
    """[P6] all documents packed by lines."""
    return chunking.chunk_files(doc_files(spark, sf_dir)).select("chunk_id", "file_path", "start_line", "end_line", "content")


@query()
def structural_match(spark, sf_dir):
    """[G1, G4, G5, U6] calls and loops in all source files by shape."""
    return structural.structural_search(files(spark, sf_dir), ["$X.append($Y)", "$X.push($$$)", "for ($$$) { $$$BODY }"])


@query()
def embed_chunks(spark, sf_dir):
    """[X26, X27, K2] the rich text of every chunk, embedded by feature hashing."""
    return embedding.embed(chunks(spark, sf_dir).select("chunk_id", tx.rich_text(ROOT).alias("rich")), "rich").select("chunk_id", "embedding")


_RICH = ORACLES["rich_text"].replace("SELECT chunk_id, md5(", "SELECT chunk_id, (", 1).replace(" AS rich_hash", " AS rich", 1)


@query(
    f"WITH parts AS (SELECT chunk_id, lower(unnest(regexp_extract_all(regexp_replace(rich, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\\P{{L}}A-Za-z]+'))) AS part FROM ({_RICH})), places AS (SELECT chunk_id, ('0x' || substr(md5(part), 7, 2))::INT AS place, CASE WHEN substr(md5(part), 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END * (1 + ln(count(*))) AS v FROM parts GROUP BY chunk_id, part),"
    " sums AS (SELECT chunk_id, place, sum(v) AS v FROM places GROUP BY chunk_id, place) SELECT chunk_id, round(sum(CASE WHEN place < 128 THEN v ELSE 0 END) / sqrt(sum(v * v)), 3) AS low, round(sum(CASE WHEN place >= 128 THEN v ELSE 0 END) / sqrt(sum(v * v)), 3) AS high FROM sums GROUP BY chunk_id"
)
def embedding_sums(spark, sf_dir):
    """[X26, X27, K2] the sums of both halves of every chunk's embedding."""
    half = lambda at: F.round(F.aggregate(F.slice("embedding", at, 128), F.lit(0.0), lambda a, x: a + x), 3)
    return embed_chunks(spark, sf_dir).select("chunk_id", half(1).alias("low"), half(129).alias("high"))


@query(f"SELECT search_id, '{{\"search_id\":' || search_id || ',\"selected_idx\":' || selected_idx || '}}' AS json FROM {_EVENTS} WHERE selected_idx IS NOT NULL")
def json_rows(spark, sf_dir):
    """[K11]"""
    rows = feedback.searches(table(spark, sf_dir, "search_feedback")).filter("selected_idx is not null")
    return rows.select("search_id", F.to_json(F.struct("search_id", "selected_idx")).alias("json"))


@query(f"SELECT file_path, line_no::INT AS line_no, CASE WHEN length(line) > 80 THEN substr(line, 1, 77) || '...' ELSE line END AS shown FROM {_LINES}")
def truncated_lines(spark, sf_dir):
    """[X25, K12]"""
    return search.lines_of(doc_files(spark, sf_dir)).select("file_path", "line_no", tx.truncated(F.col("line")).alias("shown"))


# --------------------------------------------------------------------------- feedback


def results(spark, sf_dir) -> DataFrame:
    return feedback.results_of(feedback.searches(table(spark, sf_dir, "search_feedback")))


_ACCESS = f"(SELECT r.file_path AS file_path, count(*) AS accesses FROM {_RESULTS} WHERE selected = 1 AND r.file_path IS NOT NULL GROUP BY 1)"


@query(f"SELECT file_path, accesses, round(accesses / sum(accesses) OVER (), 9) AS affinity FROM {_ACCESS}")
def user_affinity(spark, sf_dir):
    """[A6, X8, D17]"""
    return feedback.affinity(feedback.accesses(results(spark, sf_dir))).select("file_path", "accesses", F.round("affinity", 9).alias("affinity"))


@query(f"SELECT {_language('file_path')} AS language, sum(accesses)::BIGINT AS accesses FROM {_ACCESS} GROUP BY 1 ORDER BY accesses DESC, language LIMIT 5")
def preferred_languages(spark, sf_dir):
    """[A7] a top-k report."""
    return feedback.preferred_languages(feedback.accesses(results(spark, sf_dir)))


@query(f"SELECT query, max(logged_at) AS last_at FROM {_EVENTS} WHERE coalesce(query, '') <> '' GROUP BY query ORDER BY last_at DESC, query LIMIT 20")
def recent_queries(spark, sf_dir):
    """[A8] a top-k report."""
    return feedback.recent_queries(feedback.searches(table(spark, sf_dir, "search_feedback")))


_Z = " + ".join([str(WEIGHTS["intercept"])] + [f"{v} * coalesce(r.{k}, 0)" for k, v in WEIGHTS.items() if k != "intercept"])


@query(f"SELECT search_id, idx::INT AS idx, selected, round(1 / (1 + exp(-({_Z}))), 9) AS score FROM {_RESULTS}")
def ltr_score(spark, sf_dir):
    """[X10, X30, W6, D15, D16]"""
    return results(spark, sf_dir).select("search_id", "idx", "selected", F.round(ranking.ltr_score(WEIGHTS), 9).alias("score"))


@query()
def ltr_train(spark, sf_dir):
    """[A12] the weights of the learned ranking model."""
    weights = feedback.train_ltr(results(spark, sf_dir)) or {}
    return spark.createDataFrame(sorted(weights.items()), "feature string, weight double")


@query(
    f"SELECT read_id, search_id, min(idx)::INT AS idx FROM (SELECT q.search_id, q.idx, rd.read_id FROM {_RESULTS} q JOIN (SELECT search_id AS read_id, r.file_path AS file_path, r.start_line + 1 AS line FROM {_RESULTS} WHERE selected = 1) rd ON q.r.file_path = rd.file_path AND rd.line BETWEEN q.r.start_line AND q.r.end_line) GROUP BY ALL"
)
def click_attribution(spark, sf_dir):
    """[J7, M8, D22] in which searches a result held the line that was read."""
    rows = results(spark, sf_dir)
    reads = rows.filter("selected = 1").select(F.col("search_id").alias("read_id"), "file_path", (F.col("start_line") + 1).alias("line"))
    return feedback.attribute_reads(rows, reads)


# --------------------------------------------------------------------------- events and star schema


@query(
    "SELECT user_id, flush::INT AS flush, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS flush FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY ALL"
)
def sessions_idle_flush(spark, sf_dir):
    """[M2, M7] runs of each user's events without a two-hour pause."""
    df = feedback.idle_flushes(table(spark, sf_dir, "events"), "user_id", "ts", 7200)
    return df.select("user_id", F.col("flush").cast("int").alias("flush"), "first_at", "last_at", "events")


@query(
    "WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, ts, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS all_n FROM events WHERE user_id IS NOT NULL),"
    " walk AS (SELECT user_id, n, all_n, ts, 0 AS flush, [props] AS dirty FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.all_n, e.ts, CASE WHEN len(w.dirty) = 20 THEN w.flush + 1 ELSE w.flush END, CASE WHEN len(w.dirty) = 20 THEN [e.props] WHEN list_contains(w.dirty, e.props) THEN w.dirty ELSE list_append(w.dirty, e.props) END FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)"
    " SELECT user_id, flush::INT AS flush, len(dirty)::INT AS items, ts AS flushed_at FROM walk WHERE len(dirty) = 20 OR n = all_n"
)
def dirty_threshold_flush(spark, sf_dir):
    """[M1, M3] flushes of each user's dirty set at 20 different items."""
    return refresh.threshold_flushes(table(spark, sf_dir, "events"), "user_id", "ts", "props")


@query("SELECT o_custkey, o_orderkey, o_totalprice, rn::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(spark, sf_dir):
    """[W2] on the star schema."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "place")


@query("SELECT c_custkey, 'with' AS orders FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_anti(spark, sf_dir):
    """[J12, U2] on the star schema."""
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(orders, "c_custkey", "left_semi").withColumn("orders", F.lit("with")).unionByName(customer.join(orders, "c_custkey", "left_anti").withColumn("orders", F.lit("without")))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY")
def range_containment(spark, sf_dir):
    """[J7] an equi-join with a range as residual, on the star schema."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    within = F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days"))
    return li.join(o, (li.l_orderkey == o.o_orderkey) & within).select("l_orderkey", "l_linenumber", "o_custkey")
