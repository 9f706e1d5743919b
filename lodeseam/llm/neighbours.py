"""The most similar vectors for every vector (problem 5).

Balanced posting lists: centroids are fitted per model on a bounded sample and balanced by splitting the lists that
would be large; every vector is then put into the list of its nearest centroid and, near a boundary, into those of the
other centroids within a ratio of that distance.  Two vectors are compared when they share a list.  Copies of one vector
travel and are compared as one row that carries their hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.operators.incremental import model_dimensions


class CentroidGraph:
    """Centroids with a graph of near ones.

    A search enters at the nearest landmarks (centroids spread over all) and looks at the balls of centroids that a
    best-first walk over the graph reached from them. The balls are walked once, when the graph is built; landmarks with
    the same ball share it, so few centroids are looked at once each.
    """

    def __init__(self, centroids: np.ndarray, degree: int = 32, ball: int = 512, entries: int = 6):
        self.centroids, self.entries = centroids, entries
        n = len(centroids)
        degree = min(degree, n - 1)
        self.landmarks = np.arange(0, n, max(1, n // 512))
        near = np.concatenate([np.argpartition(-(centroids[i : i + 1024] @ centroids.T), degree, axis=1)[:, : degree + 1] for i in range(0, n, 1024)])
        numbers: dict[bytes, int] = {}
        self.balls: list[np.ndarray] = []
        self.ball_of = np.zeros(len(self.landmarks), dtype=np.int64)
        for at, mark in enumerate(self.landmarks):
            seen, frontier = {int(mark)}, [int(mark)]
            while frontier and len(seen) < ball:
                found = np.array(sorted({int(x) for f in frontier for x in near[f]} - seen), dtype=np.int64)
                frontier = found[np.argsort(-(centroids[found] @ centroids[mark]), kind="stable")][: ball - len(seen)].tolist()
                seen.update(frontier)
            members = np.array(sorted(seen), dtype=np.int64)
            number = numbers.setdefault(members.tobytes(), len(self.balls))
            if number == len(self.balls):
                self.balls.append(members)
            self.ball_of[at] = number

    def search(self, vectors: np.ndarray, lists: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) pairs: for each unit vector the centroids within ``ratio`` of its smallest distance, ``lists`` at most."""
        m = min(self.entries, len(self.landmarks))
        entry = np.argpartition(-(vectors @ self.centroids[self.landmarks].T), m - 1, axis=1)[:, :m]
        balls = np.sort(self.ball_of[entry], axis=1)
        first = np.ones(balls.shape, dtype=bool)
        first[:, 1:] = balls[:, 1:] != balls[:, :-1]
        who, ball = np.nonzero(first)[0], balls[first]
        order = np.argsort(ball, kind="stable")
        cuts = np.flatnonzero(np.diff(ball[order])) + 1
        found = [self._nearest(vectors, who[part], self.balls[ball[part[0]]], lists) for part in np.split(order, cuts) if len(part)]
        return self._prune(*(np.concatenate(c) for c in zip(*found)), lists, ratio) if found else (who, ball)

    def _nearest(self, vectors, rows, ids, lists):
        """(row, centroid, distance) of the nearest of the given centroids for each row."""
        r = min(lists, len(ids))
        distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors[rows] @ self.centroids[ids].T)))
        part = np.argpartition(distance, r - 1, axis=1)[:, :r]
        return np.repeat(rows, r), ids[part].ravel(), np.take_along_axis(distance, part, 1).ravel()

    @staticmethod
    def _prune(rows, ids, distance, lists, ratio):
        """The distance-ratio rule over what all balls gave, each centroid once."""
        if not len(rows):
            return rows, ids
        order = np.lexsort((ids, distance, rows))
        rows, ids, distance = rows[order], ids[order], distance[order]
        # the same centroid from two balls has the same distance and is its neighbour here
        fresh = np.concatenate([[True], (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])])
        rows, ids, distance = rows[fresh], ids[fresh], distance[fresh]
        first = np.searchsorted(rows, rows)
        keep = (np.arange(len(rows)) - first < lists) & (distance <= ratio * distance[first] + 1e-7)
        return rows[keep], ids[keep]


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """k spherical centroids of unit vectors and the share of the sample nearest to each.

    After every round but the last two, centroids with hardly any vectors move to vectors of the largest lists, which
    splits those.
    """
    rng = np.random.default_rng(7)
    k = max(1, min(k, len(sample)))
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    for turn in range(rounds):
        nearest = np.concatenate([np.argmax(sample[i : i + 8192] @ centroids.T, axis=1) for i in range(0, len(sample), 8192)])
        counts = np.bincount(nearest, minlength=k)
        order = np.argsort(nearest, kind="stable")
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        filled = np.flatnonzero(counts)
        sums = np.add.reduceat(sample[order], first[filled], axis=0)
        centroids[filled] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if turn < rounds - 2:
            mean = len(sample) / k
            small, large = np.flatnonzero(counts < 0.2 * mean), np.argsort(-counts)
            for s, big in zip(small, large):
                if counts[big] < 2 * mean:
                    break
                centroids[s] = sample[order[first[big] + rng.integers(counts[big])]]
    return centroids.astype(np.float32), counts / len(sample)


def usable_vectors(cache: DataFrame, dimensions: dict[str, int]) -> DataFrame:
    """(model, text_hash, embedding): the latest usable row of each key; of equal times the larger vector stands.

    Usable: model and hash are not null and the embedding has the model's dimension, no null, NaN or infinity, and is
    not all zero.
    """
    size = F.create_map(*[F.lit(x) for item in dimensions.items() for x in item])[F.col("model")] if dimensions else F.lit(None).cast("int")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        cache.select("model", "text_hash", "embedding", "created_at")
        .filter(F.col("text_hash").isNotNull() & (F.size("embedding") == size))
        .filter(~bad & F.exists("embedding", lambda x: x != 0))
        .groupBy("model", "text_hash")
        .agg(F.max(F.struct("created_at", "embedding")).alias("row"))
        .select("model", "text_hash", F.col("row.embedding").alias("embedding"))
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def nearest_vectors(
    cache: DataFrame,
    dimensions: dict[str, int] | None = None,
    k: int = 5,
    list_size: int = 600,
    lists: int = 10,
    ratio: float = 1.25,
    max_centroids: int = 4096,
    sample_per_list: int = 32,
    max_sample: int = 393_216,
    inner: int = 16_384,
    block: int = 131_072,
) -> DataFrame:
    """(model, text_hash, rank, neighbour, cosine): the k most similar other vectors of the same model for every vector.

    Centroids (n / list_size per model, max_centroids at most) are fitted on a deterministic sample of about
    sample_per_list vectors each, max_sample over all models; they are all that is broadcast. Every usable vector is
    indexed and searched. The task of a list with more than ``inner`` vectors fits a second level of centroids to it and
    compares within the lists of those, so work stays in proportion beyond max_centroids. A list that is expected to
    hold more than ``block`` vectors is cut into blocks, and every pair of its blocks is a task of its own, so no list is
    too large for one and none loses a pair. Similarities are computed in double precision; ties go to the smaller hash.
    A model's dimension is the length of most of its vectors where ``dimensions`` does not say. A model with one vector
    has no neighbours; an empty table gives no rows.
    """
    spark = cache.sparkSession
    dimensions = model_dimensions(cache) if dimensions is None else dimensions
    counts = {r["model"]: r["count"] for r in cache.filter(F.col("model").isin(list(dimensions))).groupBy("model").count().collect()}
    schema = "model string, text_hash string, rank int, neighbour string, cosine double"
    if not counts:
        return spark.createDataFrame([], schema)
    plan = {m: max(1, min(max_centroids, n // list_size)) for m, n in counts.items()}
    wanted = {m: min(n, max(2_000, sample_per_list * plan[m])) for m, n in counts.items()}
    less = min(1.0, max_sample / sum(wanted.values()))
    rate = F.create_map(*[F.lit(x) for m, n in counts.items() for x in (m, min(1.0, less * wanted[m] / n))])[F.col("model")]
    drawn = (
        cache.select("model", "text_hash", "embedding")
        .filter(F.col("model").isin(list(counts)) & (F.pmod(F.xxhash64("text_hash"), F.lit(1_000_003)) < rate * 1_000_003))
        .toArrow()
    )
    index: dict[str, tuple[int, CentroidGraph, np.ndarray]] = {}
    for number, model in enumerate(sorted(counts)):
        d = dimensions[model]
        own = drawn.filter(pc.and_(pc.equal(drawn.column(0), model), pc.equal(pc.list_value_length(drawn.column(2)), d))).column(2).combine_chunks()
        sample = own.flatten().fill_null(np.float32("nan")).to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)
        sample = sample[np.isfinite(sample).all(axis=1) & sample.any(axis=1)]
        if not len(sample):
            sample = np.eye(1, d, dtype=np.float32)
        # copies count once: they travel as one row
        centroids, share = balanced_centroids(_unit(np.unique(sample, axis=0)).astype(np.float32), plan[model])
        blocks = np.maximum(1, np.ceil(share * counts[model] * lists / 2 / block)).astype(np.int64)
        index[model] = (number, CentroidGraph(centroids), blocks)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = shared.value
        for batch in batches:
            models = np.array(batch.column(0).to_pylist(), dtype=object)
            hashes, arrays = batch.column(1), batch.column(2)
            for model in set(models.tolist()):
                number, graph, blocks = graphs[model]
                at = pa.array(np.flatnonzero(models == model))
                own = arrays.take(at)
                raw = np.ascontiguousarray(own.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), -1))
                names = hashes.take(at).to_pylist()
                raw, members = _collapse(raw, [[h] for h in names])
                rows, ids = graph.search(_unit(raw).astype(np.float32), lists, ratio)
                split = blocks[ids]
                if (split > 1).any():
                    reps = np.repeat(np.arange(len(rows)), split)
                    other = np.concatenate([np.arange(s) for s in split])
                    mine = np.array([hash_block(m[0]) for m in members])[rows[reps]] % split[reps]
                    rows, ids, low, high, side = rows[reps], ids[reps], np.minimum(mine, other), np.maximum(mine, other), (mine > other)
                else:
                    low = high = np.zeros(len(rows), dtype=np.int64)
                    side = np.zeros(len(rows), dtype=bool)
                blob = raw.view(np.uint8).reshape(len(raw), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((number << 48) + (ids << 24) + (low << 12) + high, type=pa.int64()),
                        pa.array(side.astype(np.int8), type=pa.int8()),
                        pa.array([model] * len(rows), type=pa.string()),
                        pa.array(members, type=pa.list_(pa.string())).take(pa.array(rows)),
                        pa.array([b.tobytes() for b in blob], type=pa.binary()).take(pa.array(rows)),
                    ],
                    names=["task", "side", "model", "hashes", "vector"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides, model, hashes, raw in _groups(batches):
            parts = [_collapse(raw[sides == side], [h for h, x in zip(hashes, sides) if x == side]) for side in (0, 1) if (sides == side).any()]
            jobs = [(parts[0], parts[1]), (parts[1], parts[0])] if len(parts) == 2 else [(parts[0], parts[0])]
            for queries, members in jobs:
                out: list[tuple[str, list[tuple[float, str]]]] = []
                rows, found, cosines = _search(queries[0], members[0], [h[0] for h in members[1]], k, members is queries, (inner, list_size, lists, ratio))
                cuts = np.searchsorted(rows, np.arange(len(queries[0]) + 1)).tolist()
                found, cosines = found.tolist(), cosines.tolist()
                for own, a, b in zip(queries[1], cuts, cuts[1:]):
                    near = [(-c, h) for j, c in zip(found[a:b], cosines[a:b]) for h in members[1][j][: k + 1]]
                    if len(own) > 1:
                        near += [(-1.0, h) for h in own[: k + 1]]
                    near.sort()
                    out.extend((h, [x for x in near[: k + 1] if x[1] != h][:k]) for h in own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([model] * len(out), type=pa.string()), pa.array([h for h, _ in out], type=pa.string()), pa.array([[{"d": d, "h": h} for d, h in near] for _, near in out], type=_NEAR)], names=["model", "text_hash", "near"]
                )

    listed = usable_vectors(cache, dimensions).mapInArrow(assign, "task bigint, side tinyint, model string, hashes array<string>, vector binary")
    near = listed.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "model string, text_hash string, near array<struct<d:double,h:string>>")
    merged = near.groupBy("model", "text_hash").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    return merged.select("model", "text_hash", F.posexplode("near").alias("pos", "n")).select("model", "text_hash", (F.col("pos") + 1).alias("rank"), F.col("n.h").alias("neighbour"), (-F.col("n.d")).alias("cosine"))


_NEAR = pa.list_(pa.struct([("d", pa.float64()), ("h", pa.string())]))


def _collapse(raw: np.ndarray, hashes: list[list[str]]) -> tuple[np.ndarray, list[list[str]]]:
    """Equal vectors as one row with all their hashes, sorted."""
    raw = np.ascontiguousarray(raw)
    _, first, group = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
    if len(first) == len(raw):
        return raw, hashes
    members: list[list[str]] = [[] for _ in first]
    for g, own in zip(group.tolist(), hashes):
        members[g].extend(own)
    return raw[first], [sorted(set(m)) for m in members]


def _search(queries: np.ndarray, members: np.ndarray, names: list[str], k: int, same: bool, level: tuple[int, int, int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine), sorted by query: the k + 1 nearest members of each query, itself left out where both are the same."""
    inner, list_size, lists, ratio = level
    unit = _unit(members)
    order = np.argsort(np.argsort(np.array(names, dtype=object), kind="stable"))
    if len(members) <= inner:
        return _scan(queries, np.arange(len(queries)), unit, np.arange(len(unit)), order, k, same)
    # a second level: the list's own centroids
    rng = np.random.default_rng(11)
    many = len(members) // list_size
    sample = rng.choice(len(unit), min(len(unit), 32 * many), replace=False)
    graph = CentroidGraph(balanced_centroids(unit[np.sort(sample)].astype(np.float32), many)[0])
    assigned = []
    for vectors in (queries, members):
        parts = [graph.search(_unit(vectors[i : i + 8192]).astype(np.float32), lists, ratio) for i in range(0, len(vectors), 8192)]
        rows = np.concatenate([r + 8192 * n for n, (r, _) in enumerate(parts)])
        ids = np.concatenate([c for _, c in parts])
        by = np.argsort(ids, kind="stable")
        assigned.append((rows[by], np.searchsorted(ids[by], np.arange(many + 1))))
    (asking, ask_cuts), (held, held_cuts) = assigned
    found = [_scan(queries, asking[a:b], unit, held[c:d], order, k, same) for a, b, c, d in zip(ask_cuts, ask_cuts[1:], held_cuts, held_cuts[1:]) if a < b and c < d]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    i, j, cosine = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((order[j], -cosine, i))
    i, j, cosine = i[by], j[by], cosine[by]
    # a member met in two lists has the same cosine and is its own neighbour here
    fresh = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    i, j, cosine = i[fresh], j[fresh], cosine[fresh]
    kept = np.arange(len(i)) - np.searchsorted(i, i) <= k
    return i[kept], j[kept], cosine[kept]


def _scan(queries: np.ndarray, asking: np.ndarray, unit: np.ndarray, held: np.ndarray, order: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) over the given queries against the given members."""
    out = []
    wide, names = unit[held], order[held]
    narrow = wide.astype(np.float32)
    for at in range(0, len(asking), 1024):
        part = asking[at : at + 1024]
        q = _unit(queries[part])
        sims = q.astype(np.float32) @ narrow.T
        if same:
            own = np.searchsorted(held, part)
            own[own == len(held)] = 0
            mine = np.flatnonzero(held[own] == part)
            sims[mine, own[mine]] = -2.0
        rows, found, cosines = _nearest_rows(sims, q, wide, names, k)
        out.append((part[rows], held[found], cosines))
    return tuple(np.concatenate(x) for x in zip(*out))


def _nearest_rows(sims: np.ndarray, queries: np.ndarray, unit: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine), sorted by query: the k + 1 best rows in double precision, ties to the smaller of ``names``.

    ``sims`` are the similarities in single precision, below -1.5 for rows that do not count. Every row that its rounding
    leaves in reach of the k-th best is a candidate, however many these are.
    """
    n, d = unit.shape

    def cosine(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # pair by pair, so that a pair has one value wherever it is met; copies agree to the last digits only, 14 make them ties
        parts = [np.einsum("ij,ij->i", unit[j[a : a + 65_536]], queries[i[a : a + 65_536]]) for a in range(0, len(i), 65_536)]
        return np.round(np.concatenate(parts), 14) if parts else np.zeros(0)

    least = np.partition(sims, n - min(k, n), axis=1)[:, n - min(k, n)]
    # a product of unit vectors is off by (d + 2) units of rounding at most, the k-th best as well
    i, j = np.nonzero((sims >= (least - 2 * (d + 4) * 2.0**-24)[:, None]) & (sims > -1.5))
    if len(i) > 32 * len(queries):
        # many candidates: those that double precision leaves in reach of the best k + 1
        rough = (queries @ unit.T)[i, j]
        order = np.lexsort((-rough, i))
        first = np.searchsorted(i, np.arange(len(queries)))
        last = np.searchsorted(i, np.arange(len(queries)), side="right")
        bound = np.where(last > first, rough[order[np.minimum(first + k, np.maximum(last - 1, 0))]], 0.0)
        kept = rough >= bound[i] - 1e-13
        i, j = i[kept], j[kept]
    found = cosine(i, j)
    order = np.lexsort((names[j], -found, i))
    kept = order[np.arange(len(i)) - np.searchsorted(i, i) <= k]
    return i[kept], j[kept], found[kept]


def hash_block(text: str) -> int:
    """A stable number for a hash string."""
    return zlib.crc32(text.encode())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, str, list[list[str]], np.ndarray]]:
    """The rows of each task, which are consecutive: (side, model, hashes, vectors)."""
    parts: list[pa.RecordBatch] = []
    current = None

    def done():
        table = pa.Table.from_batches(parts)
        vectors = np.frombuffer(b"".join(table.column(4).to_pylist()), dtype=np.float32).reshape(table.num_rows, -1)
        return np.array(table.column(1).to_pylist()), table.column(2)[0].as_py(), table.column(3).to_pylist(), vectors

    for batch in batches:
        tasks = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if current is not None and tasks[a] != current:
                yield done()
                parts = []
            current = tasks[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield done()


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(model, hash_a, hash_b), hash_a < hash_b: the pairs of which at least one is among the neighbours of the other."""
    return neighbours.select("model", F.least("text_hash", "neighbour").alias("hash_a"), F.greatest("text_hash", "neighbour").alias("hash_b")).distinct()
