import numpy as np
import pytest

from lodeseam.llm.neighbours import CentroidGraph, balanced_centroids, nearest_vectors, neighbour_pairs, usable_vectors
from lodeseam.operators.incremental import model_dimensions

DDL = "model string, text_hash string, embedding array<float>, created_at double, rank int"


def brute(rows, k):
    names = sorted(rows)
    m = np.array([rows[n] for n in names], dtype=np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    return {a: [names[j] for j in sorted((j for j in range(len(names)) if j != i), key=lambda j: (-round(s[i, j], 12), names[j]))[:k]] for i, a in enumerate(names)}


def clustered(n, d, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 25), d))
    return {f"h{i:05d}": (centres[rng.integers(len(centres))] + 0.25 * rng.normal(size=d)).astype(np.float32).tolist() for i in range(n)}


def frame(spark, rows, model="m"):
    return spark.createDataFrame([(model, h, v, 1.0, 0) for h, v in rows.items()], DDL)


def test_recall_against_brute_force(spark):
    rows = clustered(1500, 16)
    want = brute(rows, 5)
    got: dict = {}
    for r in nearest_vectors(frame(spark, rows), {"m": 16}, list_size=60).collect():
        got.setdefault(r["text_hash"], []).append((r["rank"], r["neighbour"]))
    assert set(got) == set(rows) and all(len(v) == 5 for v in got.values())
    hit = sum(len({n for _, n in got[h]} & set(want[h])) for h in rows)
    assert hit / (5 * len(rows)) >= 0.9


def test_one_list_is_exact_and_blocks_lose_nothing(spark):
    rows = clustered(240, 8, 3)
    want = brute(rows, 3)
    for block in (10_000, 40):
        got: dict = {}
        for r in nearest_vectors(frame(spark, rows), {"m": 8}, k=3, list_size=10_000, block=block).orderBy("text_hash", "rank").collect():
            got.setdefault(r["text_hash"], []).append(r["neighbour"])
        assert got == want


def test_hot_group_of_copies(spark):
    """A third of the rows hold one vector: all get neighbours, ties by hash."""
    rows = clustered(90, 6, 1) | {f"same{i:03d}": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] for i in range(45)}
    got = nearest_vectors(frame(spark, rows), {"m": 6}, list_size=20, block=30).filter("text_hash = 'same007'").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == ["same000", "same001", "same002", "same003", "same004"]
    assert all(r["cosine"] == pytest.approx(1.0) for r in got)


def test_hot_group_of_near_copies(spark):
    """More near and rescaled copies than single precision tells apart: the true neighbours, ties by hash."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=96)
    rows = {f"near{i:03d}": (base + 1e-4 * rng.normal(size=96)).astype(np.float32).tolist() for i in range(300)}
    scaled = np.array(base, dtype=np.float32)
    rows |= {f"size{i:02d}": (scaled * np.float32(2.0 ** (i - 15))).tolist() for i in range(30)}
    want = brute(rows, 5)
    for block in (10_000, 100):
        got: dict = {}
        for r in nearest_vectors(frame(spark, rows), {"m": 96}, list_size=10_000, block=block).orderBy("text_hash", "rank").collect():
            got.setdefault(r["text_hash"], []).append(r["neighbour"])
        assert got["size20"] == [f"size{i:02d}" for i in range(5)]
        assert got == want


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("m", "a", [1.0, 0.0], 1.0, 0), ("m", "a", [0.0, 1.0], 2.0, 0), ("m", "a", [0.0, 1.0], 2.0, 0), ("m", "b", [0.0, 2.0], None, 0), ("m", "c", [0.0, 0.0], 1.0, 0), ("m", "d", [nan, 1.0], 1.0, 0), ("m", "e", [1.0], 1.0, 0),
        ("m", "f", None, 1.0, 0), ("m", "g", [None, 1.0], 1.0, 0), ("m", "h", [inf, 1.0], 1.0, 0), (None, "i", [1.0, 1.0], 1.0, 0), ("m", None, [1.0, 1.0], 1.0, 0), ("other", "j", [1.0, 1.0], 1.0, 0), ("m", "a", [nan, 9.0], 9.0, 0), ("solo", "z", [1.0, 1.0, 1.0], 1.0, 0),
    ]
    df = spark.createDataFrame(rows, DDL)
    assert {(r["text_hash"], tuple(r["embedding"])) for r in usable_vectors(df, {"m": 2}).collect()} == {("a", (0.0, 1.0)), ("b", (0.0, 2.0))}
    got = nearest_vectors(df, {"m": 2, "solo": 3})
    assert [(r["model"], r["hash_a"], r["hash_b"]) for r in neighbour_pairs(got).collect()] == [("m", "a", "b")]
    assert nearest_vectors(df.limit(0), {"m": 2}).count() == 0
    assert nearest_vectors(df.filter("text_hash = 'c'"), {"m": 2}).count() == 0


def test_centroids_are_balanced_and_searched():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids, share = balanced_centroids(x, 400)
    assert share.max() < 6 / 400 and share.sum() == pytest.approx(1.0)
    graph = CentroidGraph(centroids, ball=64)
    assert len(graph.balls) > 50
    rows, ids = graph.search(x[:500], 1, 1.0)
    exact = np.argmax(x[:500] @ centroids.T, axis=1)
    assert (ids[np.argsort(rows)] == exact).mean() > 0.9


def test_a_second_level_takes_over_beyond_the_centroids(spark):
    """Two centroids for 1,500 vectors: their lists get centroids of their own, within a list and between its blocks."""
    rows = clustered(1500, 16, 4)
    want = brute(rows, 5)
    for block in (10_000, 200):
        got: dict = {}
        for r in nearest_vectors(frame(spark, rows), list_size=60, max_centroids=2, inner=150, block=block).collect():
            got.setdefault(r["text_hash"], []).append((r["rank"], r["neighbour"], r["cosine"]))
        assert set(got) == set(rows) and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
        assert all(h not in {n for _, n, _ in v} for h, v in got.items())
        hit = sum(len({n for _, n, _ in got[h]} & set(want[h])) for h in rows)
        assert hit / (5 * len(rows)) >= 0.95


@pytest.mark.parametrize("n,k", [(12_000, 100), (40_000, 1_000)])
def test_lists_hold_the_neighbours(n, k):
    """The share of true neighbours that share a list, at some and at many centroids over the graph."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(n // 50, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(len(centres), size=n)] + 0.5 / np.sqrt(32) * rng.normal(size=(n, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = CentroidGraph(balanced_centroids(x[: 32 * k], k)[0])
    asked = rng.choice(n, 200, replace=False)
    sims = x[asked] @ x.T
    sims[np.arange(200), asked] = -2
    near = np.argpartition(-sims, 5, axis=1)[:, :5]
    needed = np.unique(np.concatenate([asked, near.ravel()]))
    rows, ids = graph.search(x[needed], 10, 1.25)
    held: dict = {}
    for r, c in zip(needed[rows].tolist(), ids.tolist()):
        held.setdefault(r, set()).add(c)
    assert np.mean([bool(held[a] & held[b]) for a, bs in zip(asked.tolist(), near.tolist()) for b in bs]) >= 0.95


def test_dimensions_come_from_the_data(spark):
    rows = [("m", "a", [1.0, 0.0], 1.0, 0), ("m", "b", [0.0, 1.0], 1.0, 0), ("m", "c", [1.0], 1.0, 0), ("n", "a", [1.0, 1.0, 1.0], 1.0, 0), ("o", "a", [], 1.0, 0), ("o", "b", None, 1.0, 0), (None, "b", [1.0], 1.0, 0)]
    assert model_dimensions(spark.createDataFrame(rows, DDL)) == {"m": 2, "n": 3}


def test_p5_found_equals_its_sql(spark):
    """All pairs of the small tables, by SQL over all pairs of vectors."""
    import os

    from lodeseam.llm.queries import ORACLES, p5_found

    folder = os.environ.get("LODESEAM_TEST_TABLES", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embedding_cache as select * from '{folder}/embedding_cache.parquet'")
    assert {tuple(r) for r in p5_found(spark, folder).select("model", "hash_a", "hash_b").collect()} == set(con.sql(ORACLES["p5_found"]).fetchall())
