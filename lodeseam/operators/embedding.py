"""Embedding of texts (X26-X28): a pluggable local embedder and the cache around it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators.incremental import cache_split

DIMENSION = 256
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_A-Za-z]+")
Embedder = Callable[[list[str]], np.ndarray]


class _Features(dict):
    """part of a word as written -> feature number; parts that differ in case only share one."""

    def __init__(self):
        super().__init__()
        self.numbers: dict[str, int] = {}
        self.digests: list[tuple[int, float]] = []

    def __missing__(self, part: str) -> int:
        low = part.lower()
        number = self.numbers.get(low)
        if number is None:
            digest = hashlib.md5(low.encode()).digest()
            number = self.numbers[low] = len(self.digests)
            self.digests.append((int.from_bytes(digest[:4], "big"), 1.0 if digest[4] & 1 else -1.0))
        self[part] = number
        return number


_features = _Features()
_MOST_FEATURES = 500_000


def hashing_embedder(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Feature hashing: the parts of words, signed by their MD5, damped and scaled to unit length. No model is needed; the whole text counts."""
    global _features
    if len(_features) > _MOST_FEATURES:
        _features = _Features()  # only a memory of digests: starting anew changes nothing
    number = _features.__getitem__
    rows = [[number(p) for p in _PART.findall(text)] for text in texts]
    ids = np.fromiter((n for row in rows for n in row), dtype=np.int64, count=sum(map(len, rows)))
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(r) for r in rows])
    many = max(1, len(_features.digests))
    keys, counts = np.unique(row * many + ids, return_counts=True)
    digests = np.array(_features.digests or [(0, 0.0)], dtype=np.float64)
    row, ids = keys // many, keys % many
    place = row * dimension + digests[ids, 0].astype(np.int64) % dimension
    out = np.bincount(place, weights=digests[ids, 1] * (1.0 + np.log(counts)), minlength=len(texts) * dimension).reshape(len(texts), dimension)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def embed(texts: DataFrame, column: str, embedder: Embedder = hashing_embedder, output: str = "embedding") -> DataFrame:
    """The rows with the vectors of a text column; nulls count as empty and get zero vectors."""
    names = texts.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in texts.dtypes) + f", `{output}` array<float>"
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder([t or "" for t in batch.column(at).to_pylist()]).astype(np.float32)
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=[*names, output])

    return texts.mapInArrow(run, schema)


def embed_cached(texts: DataFrame, column: str, cache: DataFrame, model: str, embedder: Embedder = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """(rows with embeddings, new cache rows): what the cache has is taken from it, the rest is computed once per text."""
    keyed = texts.withColumn("model", F.lit(model)).withColumn("text_hash", F.md5(F.coalesce(column, F.lit(""))))
    hits, misses = cache_split(keyed, cache)
    fresh = embed(misses.select("model", "text_hash", F.col(column).alias("text")).dropDuplicates(["model", "text_hash"]), "text", embedder).drop("text")
    return hits.unionByName(misses.join(fresh, ["model", "text_hash"])), fresh
