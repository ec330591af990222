"""Shards, near-duplicates, links between vectors, url rules, the pipeline and the registered queries."""

import os
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from claimloom.llm import dartminhash, hnsw, registry, sharding, url_filter
from claimloom.llm.common import table
from claimloom.llm.components import Forest, components
from claimloom.llm.decontaminate import words_of
from claimloom.llm.url_filter import Rule

SMALL = "/root/testdata/sf0.001"


def check_shards(rows, shards):
    load = Counter()
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        load[s] = sum(r["size"] for r in own)
    return load


def test_shards_are_even_and_keep_copies_together(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for grain, block in ((sharding.GRAIN, sharding.SLOT_BLOCK), (3, 4)):
        monkeypatch.setattr(sharding, "GRAIN", grain)
        monkeypatch.setattr(sharding, "SLOT_BLOCK", block)
        rows = sharding.shard(docs, 5).collect()
        assert len(rows) == len(texts)
        load = check_shards(rows, 5)
        where = {}
        for r in rows:
            text = texts[r["doc_id"]]
            assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
            assert where.setdefault(text, r["shard"]) == r["shard"]
        if grain == 1000:
            assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)


def test_longest_first_is_the_plain_schedule():
    sizes = [random.Random(1).randint(1, 50) for _ in range(60)]
    load = [0] * 7
    placed = [0] * 60
    for i in sorted(range(60), key=lambda i: (-sizes[i], i)):
        placed[i] = min(range(7), key=lambda s: (load[s], s))
        load[placed[i]] += sizes[i]
    assert sharding.longest_first(sizes, 7) == placed


def test_shard_edges(odd):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == 8
    check_shards(rows, 3)
    assert [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 2] == [(16, 0)]
    assert sharding.shard(odd.limit(0), 3).count() == 0


def brute_groups(rows):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    forest = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both and both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                forest.join(i, j)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[forest.root(n)] = min(least.get(forest.root(n), i), i)
    return {i: least[forest.root(n)] for n, (i, _) in enumerate(rows)}


def test_groups_equal_brute_force(spark, documents, monkeypatch):
    rnd = random.Random(6)
    monkeypatch.setattr(dartminhash, "BLOCK", 3)
    rows = []
    for family in range(6):
        words = [f"v{rnd.randint(0, 400)}" for _ in range(120)]
        for _ in range(8):
            # Each copy changes the one before, so chains run past the threshold.
            words = list(words)
            if rnd.random() < 0.8:
                words[rnd.randrange(120)] = f"u{rnd.random()}"
            rows.append((len(rows), " ".join(words)))
    found = {r["doc_id"]: r for r in dartminhash.groups(documents([(i, t, "en") for i, t in rows])).collect()}
    assert {i: r["class_id"] for i, r in found.items()} == brute_groups(rows)
    assert all(r["kept"] == (r["class_id"] == i) for i, r in found.items())


def test_groups_on_documents(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.groups(docs).collect()} == brute_groups(rows)


def test_signatures_estimate_weighted_similarity():
    base, other = np.arange(1, 301, dtype=np.uint64), np.arange(61, 361, dtype=np.uint64)
    same = []
    for seed in range(40):
        shift = dartminhash.mix(np.array([seed], np.uint64))
        a = dartminhash.signature(*dartminhash.cells(dartminhash.mix(base ^ shift), np.full(300, 1.5)))
        b = dartminhash.signature(*dartminhash.cells(dartminhash.mix(other ^ shift), np.full(300, 2.0)))
        same.append((a == b).mean())
    assert np.mean(same) == pytest.approx(360 / 690, abs=0.03)


def test_group_edges(odd):
    rows = dartminhash.groups(odd).collect()
    assert len(rows) == 8 and sum(r["doc_id"] == 1 and r["kept"] for r in rows) == 2
    assert [(r["class_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]
    assert all(r["class_id"] == r["doc_id"] for r in rows if r["doc_id"] in (2, 3, 4))
    assert dartminhash.groups(odd.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(100, 130)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(ids, vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= hnsw.COSINE
    np.fill_diagonal(near, False)
    forest = Forest(len(ids))
    for i, j in zip(*np.nonzero(near)):
        forest.join(int(i), int(j))
    return {int(i): (int(near[n].sum()), int(ids[forest.root(n)])) for n, i in enumerate(ids)}


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARDS", 3)
    monkeypatch.setattr(hnsw, "BLOCK_ROWS", 400)
    rng = np.random.default_rng(2)
    parts = [rng.standard_normal((500, 16))]
    for size in (2, 5, 150):
        parts.append(rng.standard_normal(16) + 0.05 * rng.standard_normal((size, 16)))
    parts.append(np.repeat(parts[0][:1], 20, axis=0))
    vectors = np.concatenate(parts)
    ids = np.arange(len(vectors))
    frame = spark.createDataFrame([(int(i), v.tolist(), 0, "x") for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, label int, node string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(frame).collect()}
    truth = brute_links(ids, vectors)
    assert {i: c for i, (_, c) in found.items()} == {i: c for i, (_, c) in truth.items()}
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in truth.values())
    assert all(found[i][0] <= truth[i][0] for i in truth)


def test_graph_recall_and_round_trip():
    vectors = np.random.default_rng(4).standard_normal((1500, 12)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.Graph(vectors, np.arange(1500))
    nodes, _ = graph.search(vectors[:200], 64)
    true = np.argsort(-(vectors[:200] @ vectors.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nodes, true)]) >= 0.9
    again = hnsw.Graph.of_bytes(vectors, graph.to_bytes())
    assert np.array_equal(again.search(vectors[:20], 16)[0], graph.search(vectors[:20], 16)[0])


def _families(rng, many, size, dimension, noise):
    base = np.repeat(rng.standard_normal((many, dimension)), size, axis=0)
    vectors = base / np.linalg.norm(base, axis=1, keepdims=True) + noise * rng.standard_normal(base.shape)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def test_beam_is_judged_by_links_to_other_vectors():
    rng = np.random.default_rng(8)
    nodes = np.arange(6000)
    vectors = _families(rng, 1500, 4, 32, 0.03)[rng.permutation(6000)]
    graph = hnsw.Graph(vectors.astype(np.float32), nodes)
    near = vectors @ vectors.T >= hnsw.COSINE
    np.fill_diagonal(near, False)
    wanted, got = hnsw.audit(graph, vectors, hnsw._own(nodes, nodes), hnsw.BEAMS[0])
    assert wanted == near.sum() and got >= hnsw.AUDIT_RECALL * wanted
    # Vectors without links give no evidence, though each finds itself.
    alone = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    assert hnsw.audit(hnsw.Graph(alone.astype(np.float32), nodes[:64]), alone, nodes[:64], hnsw.BEAMS[0]) == (0, 0)


def test_shard_without_evidence_is_compared_whole(monkeypatch):
    rng = np.random.default_rng(9)
    vectors = np.concatenate([rng.standard_normal((1200, 32)), _families(rng, 40, 3, 32, 0.03)])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.Graph(vectors.astype(np.float32), np.arange(len(vectors)))
    wanted, _ = hnsw.audit(graph, vectors, np.arange(len(vectors)), hnsw.BEAMS[0])
    assert 0 < wanted < hnsw.AUDIT_LINKS
    # Width 0 is a shard whose beam nothing vouches for: its graph is not asked.
    monkeypatch.setattr(hnsw.Graph, "search", None)
    query, node = map(np.concatenate, zip(*hnsw.found_links(graph, vectors, vectors, 0)))
    near = vectors @ vectors.T >= hnsw.COSINE
    assert sorted(zip(query.tolist(), node.tolist())) == [tuple(p) for p in np.argwhere(near).tolist()]


def test_meeting_of_one_large_group_holds_no_pairs():
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal(16) + 0.02 * rng.standard_normal((3000, 16))
    rows = pa.table({
        "dimension": pa.array([16] * 3000, pa.int32()), "shard": pa.array([0] * 3000, pa.int32()), "node": pa.array(range(3000), pa.int64()),
        "copies": pa.array([1] * 2999 + [5], pa.int64()), "vector": pa.array(vectors.tolist()),
    })
    graphs, block = hnsw._build(rows), rows.slice(1000, 1000).select(["node", "vector"])
    for width in (0, hnsw.BEAMS[0]):
        ready = graphs.append_column("width", pa.array([width], pa.int32()))
        tracemalloc.start()
        met = hnsw._meet(ready, block).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {r["a"]: r["n"] for r in met if r["n"] is not None} == {i: 3003 for i in range(1000, 2000)}
        assert len([r for r in met if r["b"] is not None]) == 2999
        assert peak < 200e6  # its 3 million pairs are 384 MB a side


def test_production_beam_on_a_large_shard(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARDS", 1)
    vectors = _families(np.random.default_rng(10), 1500, 4, 32, 0.03)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(hnsw, "sized", lambda df: seen.extend(df.collect()) or df)
    found = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(frame).collect()}
    assert [r["width"] for r in seen if "width" in r] and all(r["width"] >= hnsw.BEAMS[0] for r in seen if "width" in r)
    truth = brute_links(np.arange(len(vectors)), vectors)
    assert sum(found.values()) >= hnsw.AUDIT_RECALL * sum(n for n, _ in truth.values())


def test_vector_edges(spark):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]),
        (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-200, 0.0]), (11, [0.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [tuple(r) for r in hnsw.near_duplicates(frame).collect()]
    assert len(out) == 13
    by_id = {r[0]: r[1:] for r in out}
    assert by_id[1] == (2, 1, True) and by_id[2] == (2, 1, False) and by_id[10] == (2, 1, False)
    assert all(by_id[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)) and by_id[None] == (0, None, True)
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


URLS = [
    "https://a.b.ORG/x", "http://example.org/es/1", "http://m.example.org/en/12?q", "http://example.org/en/2#f", "x://com/fr/", "http://s.com/de/?", "http://s.com/dex",
    "http://org", "nothing", "", None, "http://u@www.example.org:80/es/", "http://notexample.org/es/", "http://example.net/a?b=://org/", "://org/" + "p" * 50_000, "http://.org/", "http://a/b://org/",
]


def plain_verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), r.key), default=None)
    return host, path, best.key if best else None, best.verdict if best else "allow"


def test_url_rules(spark):
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "r"), (None, URLS[1], "h", "r")], "page_id long, url string, host string, rule string")
    many = [Rule(random.Random(i).choice(["allow", "block"]), f"h{i % 7}.example.org", f"/{i}/") for i in range(200)]
    for rules in (registry.RULES, tuple(many), ()):
        out = url_filter.judge(frame, rules).collect()
        assert len(out) == len(URLS) + 2
        for r in out:
            if r["page_id"] is not None:
                assert tuple(r)[1:] == plain_verdict(URLS[r["page_id"]], rules)
    assert url_filter.judge(frame.limit(0), registry.RULES).count() == 0


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    keys = spark.range(3000).selectExpr("concat('k', id) AS key", "id % 10 = 3 AS flag")
    cascade = url_filter.Cascade(keys, "flag")
    assert len(cascade.levels) > 2
    from pyspark.sql import functions as F

    assert keys.filter(cascade.contains(F.col("key")) != F.col("flag")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    before = docs.count()
    for n, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, docs, SMALL)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.filter("n_tokens <> size(ids)").count() == 0
    kept = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(i != c for i, c in kept.items()) <= 0.02 * len(kept)  # only what masking and cutting made alike


def test_pipeline_takes_odd_and_empty_documents(spark, odd, tmp_path):
    odd = odd.withColumnRenamed("row", "odd: name").withColumnRenamed("node", "text.text")
    for docs in (odd, odd.limit(0)):
        for name, apply in corpus_pipeline.STAGES:
            docs = apply(spark, docs, SMALL)
        docs.collect()


def test_near_copies_go_by_row_not_by_id(spark, documents):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one, "en"), (1, one, "en"), (2, one, "en"), (2, two, "en"), (None, three, "en"), (None, three, "en"), (None, two, "de"), (None, None, "en"), (3, "", "en")]
    out = corpus_pipeline.drop_near_copies(spark, documents(rows), SMALL).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([(1, one), (2, two), (None, three), (None, None), (3, "")])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        path = f"{SMALL}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    out = registry.QUERIES[name](spark, SMALL)
    want = con.sql(registry.SQL[name])
    columns = sorted(out.columns)
    assert sorted(want.columns) == columns
    fast = sorted(map(str, (tuple(r[c] for c in columns) for r in out.collect())))
    assert fast == sorted(map(str, want.select(*columns).fetchall()))


def test_beam_comes_from_made_probes(spark, monkeypatch):
    rng = np.random.default_rng(12)
    vectors = _families(rng, 3000, 1, 64, 0.0)
    keys = np.arange(3000)
    made = hnsw.probes(vectors, keys)
    best = (made @ vectors.T).max(1)
    assert np.array_equal(made, hnsw.probes(vectors, keys)) and ((best >= hnsw.COSINE) & (best < 0.96)).all()
    graph = hnsw.Graph(vectors.astype(np.float32), keys)
    assert hnsw.probed_beam(graph, vectors, keys) > 0
    # No link in the table, yet every shard is asked through its graph.
    monkeypatch.setattr(hnsw, "SHARDS", 2)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(hnsw, "sized", lambda df: seen.append(df.collect()) or df)
    assert all(tuple(r)[1:] == (0, r["vec_id"], True) for r in hnsw.near_duplicates(frame).collect())
    widths = [r["width"] for rows in seen for r in rows if "width" in r]
    assert len(widths) >= 2 and min(widths) >= hnsw.BEAMS[0]
    # A line has no side to go to, and where every beam is full nothing is shown.
    assert np.allclose(hnsw.probes(np.ones((2, 1)), np.arange(2)), 1.0)
    group = _families(rng, 1, 600, 16, 0.001)
    assert hnsw.probed_beam(hnsw.Graph(group.astype(np.float32), np.arange(600)), group, np.arange(600)) == 0


def test_shards_cross_spark_in_small_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = pa.table({
        "dimension": pa.array([32] * 2000, pa.int32()), "shard": pa.array([1] * 2000, pa.int32()), "node": pa.array(range(2000), pa.int64()),
        "copies": pa.array([1] * 2000, pa.int64()), "vector": pa.array(rng.standard_normal((2000, 32)).tolist()),
    })
    built = hnsw._build(rows)
    pieces = hnsw._cut(built)
    assert pieces.num_rows > 1 and max(len(b) for b in pieces.column("body").to_pylist()) <= hnsw.PIECE_BYTES
    mixed = pieces.append_column("width", pa.array([32] * pieces.num_rows, pa.int32())).take(rng.permutation(pieces.num_rows))
    whole, cut = (hnsw._opened(t) for t in (built.append_column("width", pa.array([32], pa.int32())), mixed))
    assert all((a == b).all() for a, b in zip(whole[:3], cut[:3])) and whole[4] == cut[4] == 32
    for (nodes, links), (same, found) in zip(whole[3].layers, cut[3].layers, strict=True):
        assert (nodes == same).all() and (links == found).all()
    assert hnsw._meet(mixed.slice(0, 0), rows.select(["node", "vector"])).num_rows == 0
    # What is shuffled to the queries: no row holds a whole shard.
    sent, kept = [], hnsw.stage
    monkeypatch.setattr(hnsw, "stage", lambda df, name, **kwargs: sent.append((name, df)) or kept(df, name, **kwargs))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))], "vec_id long, embedding array<double>")
    assert hnsw.near_duplicates(frame).count() == 300
    graphs = next(df for name, df in sent if name == "vector-graphs")
    assert graphs.columns == ["dimension", "shard", "probed", "piece", "body"]
