"""Clustering with heap-ordered bounds against plain rounds."""

import hashlib
import math

import duckdb
import numpy as np

from claimloom.llm import centroids, registry

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string, data int"


def plain(rows, k, rounds, dimension, seed=2):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every kept row."""
    kept = [
        (i, [min(max(math.floor(256 * float(x)), -centroids.BOUND), centroids.BOUND) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centers)):
            members = [v for (_, v), c in zip(kept, own) if c == n]
            if members:
                centers[n] = [sum(column) // len(members) for column in zip(*members)]
    found = [nearest(v) for _, v in kept]
    each = [sum(d for d, c in found if c == n) for n in range(len(centers))]
    return [
        (i, c, d, each[c], sum(each), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, found)
    ]


def clustered(docs, **how):
    return sorted(map(tuple, centroids.cluster(docs, **how).collect()), key=repr)


def test_plain_rounds(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 4)) * 4
    rows = [(i, (middle[i % 6] + rng.normal(size=4) * (0.2 if i % 9 else 3)).astype(np.float32).tolist()) for i in range(400)]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    for k, block in ((7, 1 << 22), (7, 160), (1, 64)):
        assert clustered(docs, k=k, dimension=4, block_bytes=block) == sorted(plain(rows, k, 5, 4), key=repr)


def test_only_expired_vectors_are_looked_at():
    rng = np.random.default_rng(2)
    middle = rng.integers(-4000, 4000, size=(8, 16))
    vectors = np.repeat(middle, 100, axis=0) + rng.integers(-20, 20, size=(800, 16))
    centers, lost = middle.copy(), np.zeros(8)
    bounds = centroids.Bounds(np.full(800, -1, np.int32), [[(-np.inf, i) for i in range(800)], *([] for _ in range(7))])
    assert bounds.advance(vectors, centers, lost) == 800
    moved = centers + 3
    drift = np.sqrt(((moved - centers) ** 2).sum(axis=1))
    bounds = centroids.Bounds.load(8, *bounds.dump())
    assert bounds.advance(vectors, moved, lost + 2 * drift) == 0
    assert (bounds.cluster == centroids.squared(vectors, moved).argmin(axis=1)).all()
    far = drift * 0 + 1e5
    assert bounds.advance(vectors, moved[::-1], lost + far) == 800
    assert (bounds.cluster == centroids.squared(vectors, moved[::-1]).argmin(axis=1)).all()


def test_squared_distances_are_exact():
    rng = np.random.default_rng(3)
    for high in (100, centroids.EXACT, centroids.BOUND):
        x, c = rng.integers(-high, high, size=(20, 64)), rng.integers(-high, high, size=(5, 64))
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        assert centroids.squared(x, c).tolist() == exact


def test_whole_table_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    wanted = db.execute(registry.SQL["op12_centroids"]).fetchall()
    assert sorted(map(tuple, registry.op12_centroids(spark, SMALL).collect())) == sorted(wanted)


def test_cluster_edges(spark):
    rows = [
        (1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [0.5, 1.0]), (None, [3.0, -1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]),
        (6, [1.0, float("nan")]), (7, [float("inf"), 0.0]), (8, [0.25, 0.75]), (9, [3e38, -3e38]), (10, [0.0, 1.0]), (11, [-0.001, 0.001]),
    ]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    for k in (2, 3, 40):
        assert clustered(docs, k=k, dimension=2) == sorted(plain(rows, k, 5, 2), key=repr)
    assert centroids.cluster(docs.limit(0)).count() == 0
    assert centroids.cluster(docs).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
