"""Feedback, personal affinity and the learned ranking model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.text import language_for_path
from lodeseam.schemas import FEATURES


def searches(feedback: DataFrame) -> DataFrame:
    """One row per search; of repeated ids the latest log stands."""
    return feedback.groupBy("search_id").agg(F.max(F.struct("logged_at", "query", "selected_idx", "results")).alias("row")).select("search_id", "row.*")


def results_of(events: DataFrame) -> DataFrame:
    """One row per result, with its position and whether it was chosen; features that are null count as 0."""
    rows = events.select("search_id", "query", "selected_idx", "logged_at", F.posexplode("results").alias("idx", "r"))
    features = [F.coalesce(F.col(f"r.{f}"), F.lit(0.0)).alias(f) for f in FEATURES]
    chosen = F.when(F.col("selected_idx") == F.col("idx"), 1).otherwise(0)
    return rows.select("search_id", "query", "logged_at", "idx", F.col("r.file_path").alias("file_path"), F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"), *features, chosen.alias("selected"))


def accesses(results: DataFrame) -> DataFrame:
    """(file_path, accesses): how often each file was opened from a result."""
    return results.filter("selected = 1 and file_path is not null").groupBy("file_path").agg(F.count("*").alias("accesses"))


def affinity(counts: DataFrame) -> DataFrame:
    """Each file's share of all accesses; the total is one number."""
    total = counts.agg(F.sum("accesses")).first()[0] or 1
    return counts.select("file_path", "accesses", (F.col("accesses") / float(total)).alias("affinity"))


def preferred_languages(counts: DataFrame, top: int = 5) -> DataFrame:
    """A7"""
    return counts.groupBy(language_for_path(F.col("file_path")).alias("language")).agg(F.sum("accesses").alias("accesses")).orderBy(F.desc("accesses"), "language").limit(top)


def recent_queries(events: DataFrame, top: int = 20) -> DataFrame:
    """The last different queries, latest first; empty ones do not count."""
    return events.filter("coalesce(query, '') <> ''").groupBy("query").agg(F.max("logged_at").alias("last_at")).orderBy(F.desc("last_at"), "query").limit(top)


def attribute_reads(results: DataFrame, reads: DataFrame, bin_lines: int = 64) -> DataFrame:
    """(read_id, search_id, idx): for each read and search the first result that holds the read line.

    reads has read_id, file_path and line. Lines fall into bins and every result goes to the bins it covers, so the join
    is on file and bin: a file that gets most hits is spread over its bins and only near ranges meet. Results without
    a range hold nothing.
    """
    first, last = (F.floor(F.col(c) / bin_lines).cast("bigint") for c in ("start_line", "end_line"))
    spans = results.filter("start_line <= end_line").select("search_id", "idx", "file_path", "start_line", "end_line", F.explode(F.sequence(first, last)).alias("bin"))
    placed = reads.select("read_id", "file_path", "line", F.floor(F.col("line") / bin_lines).cast("bigint").alias("bin"))
    joined = spans.join(placed, ["file_path", "bin"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return joined.groupBy("read_id", "search_id").agg(F.min("idx").alias("idx"))


def train_ltr(results: DataFrame, min_events: int = 5, max_iter: int = 200) -> dict[str, float] | None:
    """A logistic model of which result is chosen, balanced classes, L2 as of one unit of weight; None for too little data."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    seen = results.agg(F.countDistinct("search_id").alias("e"), F.count("*").alias("n"), F.sum("selected").alias("p")).first()
    if seen["e"] < min_events or not seen["n"] or not seen["p"] or seen["p"] == seen["n"]:
        return None
    n, p = seen["n"], seen["p"]
    weight = F.when(F.col("selected") == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(results.withColumn("weight", weight).withColumn("label", F.col("selected").cast("double")))
    model = LogisticRegression(weightCol="weight", standardization=False, regParam=1.0 / n, maxIter=max_iter).fit(data)
    return {"intercept": float(model.intercept)} | dict(zip(FEATURES, map(float, model.coefficients.toArray())))


def affinity_of(path: Column, shares: dict[str, float]) -> Column:
    """X8 as an expression over a small profile."""
    if not shares:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for item in shares.items() for x in item])[path], F.lit(0.0))


def idle_flushes(events: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """M2, batch twin: (key, flush, first_at, last_at, events): runs of events with no pause longer than the gap."""
    w = Window.partitionBy(key).orderBy(time, "event_id")
    pause = F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w)
    marked = events.withColumn("fresh", F.when(pause.isNull() | (pause > int(gap_seconds * 1_000_000)), 1).otherwise(0)).withColumn("flush", F.sum("fresh").over(w))
    return marked.groupBy(key, "flush").agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("events"))
