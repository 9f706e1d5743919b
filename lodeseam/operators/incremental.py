"""Change detection, index tables and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the latest; of equal times the larger row. Null times come first."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("row")).select(*keys, "row.*").select(*rows.columns)


def changed_files(current: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(path, change) with change new, modified or deleted; unchanged files give no row.

    Both sides hold one row per path. Null-safe: a null against a value is a difference, two nulls are none. Without
    a stored manifest all files are new.
    """
    if stored is None:
        return current.select("path", F.lit("new").alias("change"))
    c, s = current.alias("c"), stored.alias("s")
    same = F.expr("c.mtime <=> s.mtime and c.size <=> s.size and c.content_hash <=> s.content_hash")
    change = F.when(F.col("s.path").isNull(), "new").when(F.col("c.path").isNull(), "deleted").when(~same, "modified")
    return c.join(s, F.expr("c.path = s.path"), "full_outer").select(F.coalesce("c.path", "s.path").alias("path"), change.alias("change")).filter("change is not null")


def apply_changes(index: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """K3, M4: the index without the rows of changed files, and their fresh rows."""
    touched = changes.select(F.col("path").alias("file_path")).distinct()
    return index.join(touched, "file_path", "left_anti").unionByName(fresh.select(*index.columns))


def model_dimensions(cache: DataFrame) -> dict[str, int]:
    """The dimension of every model: the length that most of its vectors have, of equally frequent ones the larger."""
    sizes = cache.filter(F.col("model").isNotNull() & (F.size("embedding") > 0)).groupBy("model", F.size("embedding").alias("size")).count()
    return {r["model"]: r["best"]["size"] for r in sizes.groupBy("model").agg(F.max(F.struct("count", "size")).alias("best")).collect()}


def latest_embeddings(cache: DataFrame, dimensions: dict[str, int] | None = None) -> DataFrame:
    """The usable embedding of each (model, text_hash) that was written last; dimensions come from the data unless given."""
    dimensions = model_dimensions(cache) if dimensions is None else dimensions
    if not dimensions:
        return cache.select("model", "text_hash", "embedding", "created_at").limit(0)
    size = F.create_map(*[F.lit(x) for item in dimensions.items() for x in item])[F.col("model")]
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    usable = cache.filter((F.size("embedding") == size) & ~bad & F.exists("embedding", lambda x: x != 0))
    return latest(usable.select("model", "text_hash", "embedding", "created_at"), ["model", "text_hash"], "created_at")


def cache_split(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their embedding, misses) of the wanted (model, text_hash) rows."""
    keys = ["model", "text_hash"]
    return wanted.join(cache.select(*keys, "embedding"), keys), wanted.join(cache.select(*keys), keys, "left_anti")


def index_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """A5"""
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.max("last_modified").alias("last_modified"), F.sum(F.length("content")).alias("characters")
    )
