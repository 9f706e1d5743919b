"""Line search and exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType



def lines_of(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """(path, line_no, line) of every line; a null text has none."""
    return files.select(F.col(path).alias("file_path"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select("file_path", (F.col("pos") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def required_literal(pattern: str) -> str | None:
    """The longest text that every match of a regular expression must hold; None where that is not plain to see.

    Only single characters, their escapes, simple classes and quantifiers are read; any group, alternative, nested class
    or escape that takes arguments gives None.
    """
    import re

    token = re.compile(
        r"\\(?P<quoted>[^A-Za-z0-9])|(?P<other>\\[dDsSwWbBhHvVRAzZGtnrfae]|[.^$]|\[\^?(?:[^\[\]\\&^]|\\[^QE])(?:[^\[\]\\&]|\\[^QE])*\])|(?P<times>[*+?]|\{(?P<least>\d+)(?:,\d*)?\})[?+]?|(?P<plain>[^\\\[\](){}|])", re.S
    )
    runs, at, repeated = [""], 0, False
    while at < len(pattern):
        m = token.match(pattern, at)
        if m is None or (repeated and m["times"]):
            return None
        repeated = bool(m["times"])
        at = m.end()
        if m["times"]:
            if m["times"] in "*?" or (m["least"] and int(m["least"]) == 0):
                runs[-1] = runs[-1][:-1]
            runs.append("")
        elif m["other"]:
            runs.append("")
        else:
            runs[-1] += m["quoted"] or m["plain"]
    best = max(runs, key=len)
    return best if len(best) >= 3 else None


def grep(files: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, path: str = "file_path", text: str = "content") -> DataFrame:
    """The matching lines of all files.

    Files that cannot match are dropped before they are cut into lines: the pattern itself, or a text that it requires,
    is looked for in the whole content first, which reaches the scan.
    """
    whole, test = _tests(F.col(text), pattern, fixed, ignore_case)
    return lines_of(files.filter(whole), path, text).filter(test(F.col("line")))


def matching_lines(files: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, text: str = "content") -> DataFrame:
    """The files that grep finds lines in, with these lines' numbers as ``hit_lines``; nothing is moved."""
    whole, test = _tests(F.col(text), pattern, fixed, ignore_case)
    numbers = F.transform(F.split(F.col(text), "\n"), lambda line, at: F.when(test(F.regexp_replace(line, "\r$", "")), at + 1))
    return files.filter(whole).withColumn("hit_lines", F.array_compact(numbers)).filter(F.size("hit_lines") > 0)


def _tests(content, pattern: str, fixed: bool, ignore_case: bool):
    """grep's test of a whole text, and that of a line."""
    if fixed:
        needle = pattern.lower() if ignore_case else pattern
        whole = F.contains(F.lower(content) if ignore_case else content, F.lit(needle))
        test = lambda c: F.contains(F.lower(c) if ignore_case else c, F.lit(needle))
    else:
        literal = None if ignore_case else required_literal(pattern)
        whole = F.contains(content, F.lit(literal)) if literal else F.lit(True)
        regex = F.lit(("(?i)" if ignore_case else "") + pattern)
        test = lambda c: F.rlike(c, regex)
    return whole, test


def limit_per_file(matches: DataFrame, per_file: int, total: int | None = None) -> DataFrame:
    """The first matches of each file, then the first of all by path and line."""
    w = Window.partitionBy("file_path").orderBy("line_no")
    kept = matches.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_file).drop("rn")
    return kept.orderBy("file_path", "line_no").limit(total) if total else kept


def counts_by_file(matches: DataFrame) -> DataFrame:
    """A2"""
    return matches.groupBy("file_path").agg(F.count("*").alias("matches"), F.min("line_no").alias("first_line"))


def read_lines(lines: DataFrame, first: int, last: int, path: str | None = None) -> DataFrame:
    """A range of lines of one file or of all."""
    part = lines.filter(F.col("line_no").between(max(1, first), last))
    return part.filter(F.col("file_path") == path) if path is not None else part


def location_range(location: str) -> tuple[str, int, int]:
    """S9: 'file' -> lines 1-50, 'file:L' -> 25 lines around L, 'file:a-b' -> a-b."""
    import re

    m = re.fullmatch(r"(.+?):(\d+)(?:-(\d+))?", location)
    if not m:
        return location, 1, 50
    first = int(m.group(2))
    return (m.group(1), first, int(m.group(3))) if m.group(3) else (m.group(1), max(1, first - 25), first + 25)


def pattern_terms(pattern: str) -> list[str]:
    """The terms that X1 counts for a pattern."""
    import re

    clean = pattern[4:] if pattern.startswith("(?i)") else pattern
    if not any(c in clean for c in ".*+?[](){}|\\"):
        return re.findall(r"\w+", clean.lower())
    return [re.sub(r"[.*+?\\\[\](){}|^$]", "", clean.lower())]


def base_score(query_words: int, hybrid: bool, fixed: bool) -> float:
    """The weight of text matches: less where a sentence-like query also runs semantically."""
    return 0.55 if hybrid and query_words >= 4 and not fixed else 1.0


#: Queries whose vectors one pass over the table takes along.
QUERY_BLOCK = 4096


def vector_search(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str, exclude_self: bool = True) -> DataFrame:
    """T1, T2, exact: (query_id, row_id, cosine, rank), the k rows most similar to each query.

    The queries are broadcast in blocks of QUERY_BLOCK, one pass over the rows per block; every Arrow batch of rows is
    multiplied with the block, and a task sends on only its own k best per query.
    Null vectors and vectors of another dimension than the query's are no partners; zero vectors have cosine 0. Ties
    go to the smaller row id.
    """
    spark = rows.sparkSession
    kinds = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]
    schema = f"query_id {kinds[0]}, row_id {kinds[1]}, cosine double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    source = rows.select(F.col(row_id).alias("row_id"), F.col(vector).alias("vector")).filter("vector is not null")
    blocks: list[DataFrame] = []
    ids: list = []
    vectors: list = []

    def add() -> None:
        by_size: dict[int, tuple[list, np.ndarray]] = {}
        for size in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == size]
            by_size[size] = ([ids[i] for i in at], _unit(np.array([vectors[i] for i in at], dtype=np.float64).reshape(len(at), size)))
        blocks.append(source.mapInArrow(_searcher(spark.sparkContext.broadcast(by_size), k, exclude_self, arrow), schema))
        ids.clear()
        vectors.clear()

    for r in queries.select(F.col(query_id).alias("i"), F.col(vector).alias("v")).filter("v is not null and i is not null").toLocalIterator():
        ids.append(r["i"])
        vectors.append(r["v"])
        if len(ids) == QUERY_BLOCK:
            add()
    if ids or not blocks:
        add()
    found = blocks[0]
    for b in blocks[1:]:
        found = found.unionByName(b)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "row_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _searcher(shared, k: int, exclude_self: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # per dimension: query numbers, row ids, cosines
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for size, (ids, queries) in shared.value.items():
                at = np.flatnonzero(sizes == size)
                if not len(at):
                    continue
                own = batch.column(0).take(pa.array(at)).to_pylist()
                flat = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                sims = queries @ _unit(np.nan_to_num(flat).reshape(len(at), size)).T
                if exclude_self:
                    place = {r: j for j, r in enumerate(own)}
                    for i, q in enumerate(ids):
                        if q in place:
                            sims[i, place[q]] = -np.inf
                cut = np.partition(sims, max(0, len(at) - k), axis=1)[:, [max(0, len(at) - k)]]
                i, j = np.nonzero((sims >= cut) & (sims > -np.inf))
                found = i, np.array(own)[j], sims[i, j]
                best[size] = _best(tuple(map(np.concatenate, zip(best[size], found))) if size in best else found, k)
        for size, (i, rows, cosine) in best.items():
            ids = shared.value[size][0]
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], type=schema[0].type), pa.array(rows.tolist(), type=schema[1].type), pa.array(cosine)], schema=schema)

    return run


def _best(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query number by cosine, then row id."""
    query, rows, cosine = found
    order = np.lexsort((rows, -cosine, query))
    query, rows, cosine = query[order], rows[order], cosine[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], rows[place < k], cosine[place < k]


def best_of_variants(results: DataFrame, penalty: float = 0.9) -> DataFrame:
    """A3: (query_id, row_id, variant, score): a row's best score over a query's variants.

    ``results`` has query_id, variant (0 is the query itself), row_id and score; the score of other variants is
    multiplied by the penalty. Of equal scores the earlier variant stands.
    """
    weighted = F.col("score") * F.when(F.col("variant") == 0, 1.0).otherwise(penalty)
    return (
        results.withColumn("weighted", weighted)
        .groupBy("query_id", "row_id")
        .agg(F.max(F.struct("weighted", (-F.col("variant")).alias("v"))).alias("best"))
        .select("query_id", "row_id", (-F.col("best.v")).alias("variant"), F.col("best.weighted").alias("score"))
    )


