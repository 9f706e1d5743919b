"""Scoring, deduplication and caps of hits."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseam.functions.text import language_match, lexical_overlap, normalised_text, path_parent, path_stem, recency, symbol_match
from lodeseam.schemas import FEATURES


@dataclass(frozen=True)
class RankWeights:
    """D13; ``ast`` takes no part in the score, as in the original formula (Q1)."""

    semantic: float = 0.5
    grep: float = 0.3
    ast: float = 0.15
    hybrid_boost: float = 0.08
    symbol_boost: float = 0.08
    lexical_boost: float = 0.05
    recency_boost: float = 0.03
    language_boost: float = 0.02
    user_affinity_boost: float = 0.04
    context_boost: float = 0.05
    graph_boost: float = 0.04

    @classmethod
    def from_env(cls, environ: dict[str, str], prefix: str = "LODESEAM_RANK_") -> "RankWeights":
        """Values of <prefix><FIELD>; what is no number is passed over."""
        found = {}
        for name in asdict(cls()):
            try:
                found[name] = float(environ[prefix + name.upper()])
            except (KeyError, ValueError):
                continue
        return cls(**found)

    def with_overrides(self, **values: float | None) -> "RankWeights":
        return replace(self, **{k: float(v) for k, v in values.items() if v is not None})

    def adapted(self, query_type: str, confidence: float) -> "RankWeights":
        """Moved towards the preset of the query's type by its confidence."""
        preset = PRESETS.get(query_type)
        if preset is None:
            return self
        a = min(1.0, max(0.0, confidence))
        return replace(self, **{k: getattr(self, k) * (1 - a) + v * a for k, v in zip(("semantic", "grep", "ast"), preset)})


# Semantic, grep and AST weight by type of query.
PRESETS = {"identifier": (0.2, 0.7, 0.3), "natural_language": (0.8, 0.1, 0.15), "pattern": (0.1, 0.8, 0.2)}


def adapted_weights(query_type: Column, confidence: Column, base: RankWeights = RankWeights()) -> Column:
    """X19 for many queries at once: the struct of semantic, grep and ast weight after the move towards the type's preset."""
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0))))
    fields = []
    for at, name in enumerate(("semantic", "grep", "ast")):
        preset = F.create_map(*[F.lit(x) for kind, values in PRESETS.items() for x in (kind, values[at])])[query_type]
        fields.append(F.coalesce(F.lit(getattr(base, name)) * (1 - a) + preset * a, F.lit(getattr(base, name))).alias(name))
    return F.struct(*fields)


#: What an AST match and a relevance signal add together.
CONFIRMATION = 0.20


def related_file(path: Column, imports: list[str]) -> Column:
    """An import's last part is the file's stem or occurs in its path."""
    tails = sorted({i.split(".")[-1].split("/")[-1] for i in imports if i})
    out = F.lit(False)
    for t in tails:
        out = out | (path_stem(path) == t) | F.contains(path, F.lit(t))
    return out


def context_match(path: Column, current_file: str | None, related_imports: list[str] = ()) -> Column:
    """J8"""
    if not current_file:
        return F.lit(0.0)
    out = F.when(path == current_file, 1.0).when(path_parent(path) == path_parent(F.lit(current_file)), 0.6)
    return out.when(related_file(path, list(related_imports)), 0.4).otherwise(0.0)


def graph_match(files: list[str] | None, symbols: list[str] | None) -> Column:
    """J10, for the small sets that one query's graph lookup gives."""
    out = F.lit(False)
    if files:
        out = out | F.col("file_path").isin(list(files))
    if symbols:
        out = out | F.coalesce(F.arrays_overlap("symbols", F.array(*[F.lit(s) for s in symbols])), F.lit(False))
    return F.when(out, 1.0).otherwise(0.0)


def score_hits(
    hits: DataFrame,
    query: Column,
    now: float | Column,
    weights: RankWeights = RankWeights(),
    ast_exhaustive: bool = False,
    affinity: Column | None = None,
    context: Column | None = None,
    graph: Column | None = None,
    ltr: dict[str, float] | None = None,
) -> DataFrame:
    """The seven boosts and the score of every hit; one projection, no shuffle.

    affinity, context and graph are the hit's matches in 0..1 and default to none. With ``ltr`` weights the score is
    blended half and half with the learned model's. A null query gives no query boosts.
    """
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    boosts = {
        "symbol_boost": weights.symbol_boost * symbol_match(query, F.col("symbols")),
        "lexical_boost": weights.lexical_boost * lexical_overlap(query, F.col("preview"), F.col("symbols")),
        "recency_boost": weights.recency_boost * F.coalesce(recency(F.col("last_modified"), now if isinstance(now, Column) else F.lit(float(now))), F.lit(0.0)),
        "language_boost": weights.language_boost * F.coalesce(language_match(query, F.col("language")), F.lit(0.0)),
        "user_affinity_boost": weights.user_affinity_boost * (affinity if affinity is not None else F.lit(0.0)),
        "context_boost": weights.context_boost * (context if context is not None else F.lit(0.0)),
        "graph_boost": weights.graph_boost * (graph if graph is not None else F.lit(0.0)),
    }
    df = hits.withColumns(boosts)
    total = sum((F.col(b) for b in boosts), F.lit(0.0))
    g, s, a = clamp(F.col("grep_score")), clamp(F.col("semantic_score")), clamp(F.col("ast_score"))
    base = weights.semantic * s + weights.grep * g
    one = F.lit(1.0)
    score = (
        F.when((a > 0) & ((g > 0) | (s > 0)), clamp(base + CONFIRMATION + total))
        .when(a > 0, F.least(one, a * (1.0 if ast_exhaustive else 0.7) + total))
        .when((s > 0) & (g > 0), clamp(base + weights.hybrid_boost + total))
        .when(s > 0, F.least(one, s + total))
        .when(g > 0, F.least(one, g + total))
        .otherwise(total)
    )
    df = df.withColumn("score", score)
    if ltr:
        df = df.withColumn("score", 0.5 * F.col("score") + 0.5 * ltr_score(ltr))
    return df


def ltr_score(weights: dict[str, float]) -> Column:
    """The logistic model over the features; missing ones count as 0."""
    z = F.lit(float(weights.get("intercept", 0.0)))
    for name in FEATURES:
        z = z + float(weights.get(name, 0.0)) * F.coalesce(F.col(name), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-z))


def ranked(hits: DataFrame, partition: list[str]) -> Window:
    """The total order of hits: score, then place."""
    return Window.partitionBy(*partition).orderBy(F.desc("score"), "file_path", "start_line", "end_line")


def dedupe_previews(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """Of hits with the same preview but for white space the best ranked stays."""
    keyed = hits.withColumn("preview_key", F.md5(normalised_text(F.col("preview"))))
    return keyed.withColumn("rn", F.row_number().over(ranked(keyed, [by, "preview_key"]))).filter("rn = 1").drop("rn", "preview_key")


def cap_per_file(hits: DataFrame, most: int = 3, by: str = "query_id") -> DataFrame:
    """At most so many hits of a file, the best ranked; no cap where most <= 0."""
    if most <= 0:
        return hits
    return hits.withColumn("rn", F.row_number().over(ranked(hits, [by, "file_path"]))).filter(F.col("rn") <= most).drop("rn")


def top_hits(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of every query, with their rank."""
    return hits.withColumn("rank", F.row_number().over(ranked(hits, [by]))).filter(F.col("rank") <= k)


def rerank(hits: DataFrame, query: Column, now: float, k: int = 10, max_per_file: int = 3, **scoring) -> DataFrame:
    """Score, deduplicate, cap per file, top k."""
    return top_hits(cap_per_file(dedupe_previews(score_hits(hits, query, now, **scoring)), max_per_file), k)


def precise(hits: DataFrame, by: str = "query_id", salts: int = 64) -> DataFrame:
    """only hits that grep or AST confirm, where a query has any such hit.

    One flag per query is aggregated map-side and joined back under every salt, so a query with any number of hits stays
    spread over that many tasks.
    """
    exact = F.coalesce((F.col("grep_score") > 0) | (F.col("ast_score") > 0), F.lit(False))
    marked = hits.withColumns({"exact": exact, "salt": F.pmod(F.xxhash64("file_path", "start_line"), F.lit(salts))})
    flags = marked.groupBy(F.col(by).alias("flag_of")).agg(F.max("exact").alias("some_exact"))
    spread = flags.withColumn("flag_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    joined = marked.join(spread, F.col(by).eqNullSafe(F.col("flag_of")) & (F.col("salt") == F.col("flag_salt")))
    return joined.filter("exact or not some_exact").select(*hits.columns)


def top_files(hits: DataFrame, most: int) -> DataFrame:
    """The files of the best hits, by best engine score, then path: what a narrowed structural search looks at."""
    best = hits.groupBy("file_path").agg(F.max(F.greatest("grep_score", "semantic_score")).alias("best"))
    return best.orderBy(F.desc("best"), "file_path").limit(most)


def stage_counts(hits: DataFrame) -> DataFrame:
    """A10: hits and files of each engine."""
    return hits.groupBy("source").agg(F.count("*").alias("hits"), F.countDistinct("file_path").alias("files"))


def only_related(hits: DataFrame, graph: DataFrame) -> DataFrame:
    """hits in files of the graph rows or sharing a symbol; all hits where the graph has no rows.

    ``graph`` has file_path and symbol; both sides of the test are semi-joins.
    """
    if graph.limit(1).count() == 0:
        return hits
    files = graph.select("file_path").distinct()
    keyed = hits.withColumn("row_key", F.xxhash64("query_id", "file_path", "start_line", "end_line", "source"))
    by_symbol = keyed.select("row_key", F.explode("symbols").alias("symbol")).join(graph.select("symbol").distinct(), "symbol", "left_semi").select("row_key")
    by_file = keyed.join(files, "file_path", "left_semi").select("row_key")
    return keyed.join(by_symbol.unionByName(by_file).distinct(), "row_key", "left_semi").drop("row_key")
