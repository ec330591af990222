"""Embedding near-duplicates with navigable small-world graphs, one per shard, searched by every vector.

Vectors are dealt over shards by hash. A shard's graph has layers: each vector is in the bottom one and, by
its hash, in a few above, which are ever smaller. A search goes down the layers and keeps a beam of the best
vectors met. Many searches move in step, so the work is array operations. Blocks of queries meet every
shard.

The beam of a shard is found by evidence that every table gives: made probes, unit vectors at a known cosine
from stored ones, are compared with the whole shard, and the narrowest beam that finds nearly all of their
links is taken. A bounded sample of real vectors is a second witness: where its links to other vectors are many
enough and the beam misses some, the beam is widened. Only a shard in which no beam passes is compared whole with every
query, and so is a query whose beam is full of links. Links are verified in double precision. A meeting puts
out counts and a spanning forest of its links, never all pairs.

Vectors with equal components are one class, so copies do not crowd the graphs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.components import Forest, components, sized
from claimloom.llm.hashing import mix
from claimloom.sinks import scratch, stage

COSINE = 0.9
#: A shard holds at most about so many classes and so many bytes; there are at least ``SHARDS``.
SHARD_ROWS, SHARD_BYTES, SHARDS = 50_000, 1 << 25, 8
#: So do the blocks of queries. A table with fewer meetings of a shard and a block than these has more, smaller blocks.
BLOCK_ROWS, BLOCK_BYTES, MEETINGS, LEAST_ROWS = 1 << 16, 1 << 25, 64, 8192
#: A shard crosses Spark in pieces of so many bytes: a row is copied, buffered and read ahead whole.
PIECE_BYTES = 1 << 14
LINKS = 16
BUILD_BEAM = 48
#: Beams that are tried, in order. Past the last one a search costs more than the whole shard.
BEAMS = (32, 64, 128, 256)
STEP_ROWS, STEP_NODES = 512, 4096
VERIFY_ROWS = 1 << 16
#: Made probes of a shard and the range of their cosines to the vectors they are made from.
PROBES, PROBE_NEAR = 1024, (COSINE + 0.001, COSINE + 0.05)
#: About so many real vectors are asked too; they judge a beam from so many links on.
AUDIT_ROWS = 4096
AUDIT_LINKS, AUDIT_RECALL = 1000, 0.995


def _beam(graph: np.ndarray, vectors: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities of the beams, best first; -1 where a beam has fewer."""
    rows = np.arange(len(queries))
    start = start.copy()
    for k in range(1, start.shape[1]):
        start[(start[:, :k] == start[:, k : k + 1]).any(1), k] = -1
    met = np.zeros((len(queries), len(vectors) + 1), bool)
    met[:, -1] = True  # what -1 points to
    nodes = np.full((len(queries), width), -1)
    near = np.full((len(queries), width), -np.inf, np.float32)
    take = min(width, start.shape[1])
    nodes[:, :take] = start[:, :take]
    near[:, :take] = np.where(nodes[:, :take] >= 0, (vectors[nodes[:, :take]] @ queries[:, :, None])[..., 0], -np.inf)
    met[rows[:, None], nodes[:, :take]] = True
    spent = nodes < 0
    while True:
        open_ = np.where(spent, -np.inf, near)
        best = open_.argmax(1)
        live = np.flatnonzero(open_[rows, best] > -np.inf)
        if not len(live):
            order = np.argsort(-near, axis=1, kind="stable")
            return np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)
        spent[live, best[live]] = True
        around = graph[nodes[live, best[live]]]
        fresh = ~met[live[:, None], around]
        met[live[:, None], around] = True
        reach = (vectors[around] @ queries[live][:, :, None])[..., 0]
        reach[~fresh] = -np.inf
        # Only queries that met something better than the worst of their beam change.
        better = np.flatnonzero((reach > near[live].min(1)[:, None]).any(1))
        if not len(better):
            continue
        live = live[better]
        all_near = np.concatenate([near[live], reach[better]], axis=1)
        all_nodes = np.concatenate([nodes[live], around[better]], axis=1)
        all_spent = np.concatenate([spent[live], np.zeros_like(around[better], bool)], axis=1)
        top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        near[live] = np.take_along_axis(all_near, top, 1)
        nodes[live] = np.where(np.isfinite(near[live]), np.take_along_axis(all_nodes, top, 1), -1)
        spent[live] = np.take_along_axis(all_spent, top, 1) | (nodes[live] < 0)


def _chosen(vectors: np.ndarray, nodes: np.ndarray, near: np.ndarray, many: int) -> np.ndarray:
    """Up to ``many`` neighbours a row: first those nearer to the row than to a chosen one, then the nearest left."""
    nodes = nodes[:, : 3 * many]
    near = near[:, : 3 * many]
    held = vectors[nodes]
    among = held @ held.transpose(0, 2, 1)
    picked = np.zeros(nodes.shape, bool)
    for i in range(nodes.shape[1]):
        closest = np.where(picked, among[:, i, :], -np.inf).max(1)
        picked[:, i] = (nodes[:, i] >= 0) & (near[:, i] > closest) & (picked.sum(1) < many)
    rank = np.where(nodes < 0, 2, np.where(picked, 0, 1))
    order = np.argsort(rank, axis=1, kind="stable")[:, :many]
    out = np.take_along_axis(nodes, order, 1)
    if out.shape[1] < many:
        out = np.concatenate([out, np.full((len(out), many - out.shape[1]), -1)], axis=1)
    return out


class Graph:
    """Layers of neighbour lists over unit vectors, the smallest layer first."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray):
        self.vectors = vectors
        draw = (mix(keys.astype(np.uint64)) >> np.uint64(11)) * 2.0**-53 + 1e-18
        height = np.floor(-np.log(draw) / np.log(LINKS)).astype(int)
        height = np.minimum(height, max(0, int(np.log(max(len(keys), 1)) / np.log(LINKS)) - 1))
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(height.max(initial=0), -1, -1):
            members = np.flatnonzero(height >= level)
            if len(members):
                self._add_layer(members, 2 * LINKS if level == 0 else LINKS)

    def _start(self, queries: np.ndarray, layers: int, members: np.ndarray) -> np.ndarray:
        """Entry points in a layer with these ``members``, from the layers above it."""
        found = np.zeros((len(queries), 1), int)
        above = None
        for nodes, graph in self.layers[:layers]:
            start = found if above is None else np.searchsorted(nodes, above)
            places, _ = _beam(graph, self.vectors[nodes], queries, start, 8)
            above = nodes[places[:, :4].clip(0)]
        return found if above is None else np.searchsorted(members, above)

    def _add_layer(self, members: np.ndarray, many: int) -> None:
        vectors = self.vectors[members]
        graph = np.full((len(members), many), -1)
        order = np.argsort(mix(members.astype(np.uint64)))
        done = np.zeros(len(members), bool)
        entry = self._start(vectors, len(self.layers), members)
        first = order[: STEP_ROWS]
        for at in range(0, len(order), STEP_ROWS):
            new = order[at : at + STEP_ROWS]
            near = vectors[new] @ vectors[new].T
            np.fill_diagonal(near, -np.inf)
            nodes = np.broadcast_to(new, near.shape)
            if at:
                start = np.where(done[entry[new]], entry[new], -1)
                start = np.concatenate([start, np.full((len(new), 1), first[0])], axis=1)
                old, old_near = _beam(graph, vectors, vectors[new], start, BUILD_BEAM)
                nodes, near = np.concatenate([nodes, old], axis=1), np.concatenate([near, old_near], axis=1)
            best = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
            nodes, near = np.take_along_axis(nodes, best, 1), np.take_along_axis(near, best, 1)
            nodes = np.where(np.isfinite(near), nodes, -1)
            graph[new] = _chosen(vectors, nodes, near, many)[:, :many]
            done[new] = True
            self._link_back(graph, vectors, new, many)
        self.layers.append((members, graph))

    @staticmethod
    def _link_back(graph: np.ndarray, vectors: np.ndarray, new: np.ndarray, many: int) -> None:
        source = np.repeat(new, many)
        target = graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, starts, counts = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(heads), STEP_ROWS):
            some, begin, count = heads[at : at + STEP_ROWS], starts[at : at + STEP_ROWS], counts[at : at + STEP_ROWS]
            width = int(count.max())
            place = begin[:, None] + np.arange(width)
            extra = np.where(np.arange(width) < count[:, None], source[np.minimum(place, len(source) - 1)], -1)
            extra = np.where((extra[:, :, None] == graph[some][:, None, :]).any(2), -1, extra)
            nodes = np.concatenate([graph[some], extra], axis=1)
            near = np.where(nodes >= 0, (vectors[nodes] @ vectors[some][:, :, None])[..., 0], -np.inf)
            best = np.argsort(-near, axis=1, kind="stable")
            nodes, near = np.take_along_axis(nodes, best, 1), np.take_along_axis(near, best, 1)
            graph[some] = _chosen(vectors, nodes, near, many)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        members, graph = self.layers[-1]
        start = self._start(queries, len(self.layers) - 1, members)
        return _beam(graph, self.vectors, queries, start, min(width, len(members)))

    def to_bytes(self) -> bytes:
        sizes = [len(self.layers)] + [n for nodes, graph in self.layers for n in graph.shape]
        parts = [np.array(sizes, np.int64).tobytes()]
        parts += [part.astype(np.int32).tobytes() for layer in self.layers for part in layer]
        return b"".join(parts)

    @classmethod
    def of_bytes(cls, vectors: np.ndarray, raw: bytes | memoryview) -> Graph:
        new = cls.__new__(cls)
        new.vectors, new.layers = vectors, []
        count = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, 2 * count, 8)
        at = 8 + 16 * count
        for rows, many in sizes.reshape(-1, 2):
            nodes = np.frombuffer(raw, np.int32, rows, at).astype(np.int64)
            graph = np.frombuffer(raw, np.int32, rows * many, at + 4 * rows).reshape(rows, many).astype(np.int64)
            new.layers.append((nodes, graph))
            at += 4 * rows * (1 + many)
        return new


def _slack(dimension: int) -> float:
    """How far a similarity in single precision may be off."""
    return max(1e-5, (dimension + 4) * 2.0**-23)


def _own(asking: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The place of each query among the sorted ``nodes``, -1 where it is not one of them."""
    place = np.searchsorted(nodes, asking).clip(max=len(nodes) - 1)
    return np.where(nodes[place] == asking, place, -1)


def audit(graph: Graph, queries: np.ndarray, own: np.ndarray, width: int, threshold: float = COSINE) -> tuple[int, int]:
    """Links from ``queries`` to vectors other than themselves, and how many of these beams of ``width`` find.

    Queries with full beams are left out: they are compared with the whole shard anyway.
    """
    asked = queries.astype(np.float32)
    low = np.float32(threshold - _slack(queries.shape[1]))
    wanted = got = 0
    for at in range(0, len(asked), STEP_ROWS):
        nodes, near = graph.search(asked[at : at + STEP_ROWS], width)
        judged = np.flatnonzero(near[:, -1] < low)
        self_ = own[at : at + STEP_ROWS][judged]
        row, column = np.nonzero(near[judged] >= low)
        got += int((nodes[judged[row], column] != self_[row]).sum())
        for first in range(0, len(graph.vectors), STEP_NODES):
            true = (asked[at + judged] @ graph.vectors[first : first + STEP_NODES].T) >= low
            inside = np.flatnonzero((self_ >= first) & (self_ < first + STEP_NODES))
            true[inside, self_[inside] - first] = False
            wanted += int(true.sum())
    return wanted, got


def probes(exact: np.ndarray, keys: np.ndarray, many: int = PROBES) -> np.ndarray:
    """Unit vectors at ``PROBE_NEAR`` to stored ones, which are taken in the order of their hashes; the same in every run."""
    target = exact[np.resize(np.argsort(mix(keys.astype(np.uint64)), kind="stable"), many)]
    side = np.random.default_rng(len(exact)).standard_normal(target.shape)
    side -= (side * target).sum(1, keepdims=True) * target
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    near = np.linspace(*PROBE_NEAR, many)[:, None]
    made = near * target + np.sqrt(1 - near**2) * side
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def probed_beam(graph: Graph, exact: np.ndarray, keys: np.ndarray) -> int:
    """The narrowest beam that finds nearly all links of the probes; 0 if none does.

    Probes with full beams are no evidence, so at least half as many links as probes must be judged.
    """
    asked = probes(exact, keys)
    alone = np.full(len(asked), -1)
    for width in BEAMS:
        wanted, got = audit(graph, asked, alone, width)
        if wanted >= len(asked) // 2 and got >= AUDIT_RECALL * wanted:
            return width
    return 0


def found_links(graph: Graph, exact: np.ndarray, queries: np.ndarray, width: int, threshold: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (query, node) of all links found by beams of ``width``, ordered by query; width 0 compares all.

    ``exact`` and ``queries`` are unit vectors. A full beam may hide links, so its query is compared with all too.
    Similarities too near to the threshold for single precision are taken again in double. A block holds at
    most ``STEP_ROWS`` * ``STEP_NODES`` links.
    """
    asked = queries.astype(np.float32)
    slack = _slack(queries.shape[1])
    low, high = np.float32(threshold - slack), np.float32(threshold + slack)

    def sound(query: np.ndarray, node: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = near >= high
        unsure = np.flatnonzero(~keep)
        for at in range(0, len(unsure), VERIFY_ROWS):
            some = unsure[at : at + VERIFY_ROWS]
            keep[some] = np.einsum("kd,kd->k", queries[query[some]], exact[node[some]]) >= threshold
        return query[keep], node[keep]

    for at in range(0, len(asked), STEP_ROWS):
        whole = some = np.arange(at, min(at + STEP_ROWS, len(asked)))
        if 0 < width < len(graph.vectors):
            nodes, near = graph.search(asked[some], width)
            full = near[:, -1] >= low
            row, column = np.nonzero((near >= low) & ~full[:, None])
            yield sound(some[row], nodes[row, column], near[row, column])
            whole = some[full]
        for first in range(0, len(graph.vectors) if len(whole) else 0, STEP_NODES):
            near = asked[whole] @ graph.vectors[first : first + STEP_NODES].T
            row, column = np.nonzero(near >= low)
            yield sound(whole[row], first + column, near[row, column])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision from a column of equal-length lists."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _build(group: pa.Table) -> pa.Table:
    group = group.sort_by("node")
    exact = _matrix(group.column("vector"))
    keys = group.column("node").to_numpy()
    graph = Graph(exact.astype(np.float32), keys)
    row = {
        "dimension": group.column("dimension")[0].as_py(), "shard": group.column("shard")[0].as_py(),
        "nodes": group.column("node").to_numpy().astype(np.int64).tobytes(), "copies": group.column("copies").to_numpy().astype(np.int64).tobytes(),
        "vectors": exact.tobytes(), "graph": graph.to_bytes(), "probed": probed_beam(graph, exact, keys),
    }
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int32()]
    return pa.Table.from_pylist([row], schema=pa.schema(list(zip(row, kinds))))


_PIECES = "dimension int, shard int, probed int, piece int, body binary"
_BODY = ("nodes", "copies", "vectors", "graph")


def _cut(built: pa.Table) -> pa.Table:
    """A built shard in rows of at most ``PIECE_BYTES``."""
    row = built.to_pylist()[0]
    body = b"".join([np.array([len(row[c]) for c in _BODY], np.int64).tobytes(), *(row[c] for c in _BODY)])
    cut = [body[at : at + PIECE_BYTES] for at in range(0, len(body), PIECE_BYTES)]
    same = {c: pa.array([row[c]] * len(cut), pa.int32()) for c in ("dimension", "shard", "probed")}
    return pa.table(same | {"piece": pa.array(range(len(cut)), pa.int32()), "body": pa.array(cut, pa.binary())})


def _joined(pieces: pa.Table) -> dict[str, memoryview]:
    """The parts of a shard's body, whose pieces may come in any order; views of one copy."""
    cut = pieces.column("body").to_pylist()
    body = memoryview(b"".join([cut[i] for i in np.argsort(pieces.column("piece").to_numpy())]))
    ends = 8 * len(_BODY) + np.cumsum([0, *np.frombuffer(body, np.int64, len(_BODY))])
    return {name: body[start:end] for name, start, end in zip(_BODY, ends, ends[1:])}


def _opened(graphs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph, int]:
    row = {c: graphs.column(c)[0].as_py() for c in ("dimension", "width")}
    row |= _joined(graphs) if "piece" in graphs.column_names else {c: graphs.column(c)[0].as_py() for c in _BODY}
    nodes, copies = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["copies"], np.int64)
    exact = np.frombuffer(row["vectors"], np.float64).reshape(len(nodes), row["dimension"])
    return nodes, copies, exact, Graph.of_bytes(exact.astype(np.float32), row["graph"]), row["width"]


def _audit(graphs: pa.Table, sample: pa.Table) -> pa.Table:
    counted = []
    if graphs.num_rows and sample.num_rows:
        nodes, _, _, graph, width = _opened(graphs)
        if width < len(nodes):
            own = _own(sample.column("node").to_numpy(), nodes)
            wanted, got = audit(graph, _matrix(sample.column("vector")), own, width)
            counted.append({"dimension": graphs.column("dimension")[0].as_py(), "shard": graphs.column("shard")[0].as_py(), "wanted": wanted, "got": got})
    kinds = [("dimension", pa.int32()), ("shard", pa.int32()), ("wanted", pa.int64()), ("got", pa.int64())]
    return pa.Table.from_pylist(counted, schema=pa.schema(kinds))


def _meet(graphs: pa.Table, block: pa.Table) -> pa.Table:
    if not graphs.num_rows or not block.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    nodes, copies, exact, graph, width = _opened(graphs)
    asking = block.column("node").to_numpy()
    counts = np.zeros(len(asking), np.int64)
    names = np.unique(np.concatenate([asking, nodes]))
    asks, holds = np.searchsorted(names, asking), np.searchsorted(names, nodes)
    # A vector and its label are in one set of the forest; equal labels need no look at the forest.
    forest, label, a, b = Forest(len(names)), np.arange(len(names)), [], []
    for query, node in found_links(graph, exact, _matrix(block.column("vector")), width):
        other = asking[query] != nodes[node]
        query, node = query[other], node[other]
        counts += np.bincount(query, copies[node], len(asking)).astype(np.int64)
        heads, starts = np.unique(query, return_index=True)
        for x, near in zip(asks[heads].tolist(), np.split(holds[node], starts[1:])):
            apart = near[label[near] != label[x]]
            if not len(apart):
                continue
            for y in apart[np.unique(label[apart], return_index=True)[1]].tolist():
                if forest.join(x, y):
                    a.append(int(names[x]))
                    b.append(int(names[y]))
            label[near] = label[x] = forest.root(x)
    linked = np.flatnonzero(counts)
    return pa.table(
        {
            "a": pa.array([*asking[linked].tolist(), *a], pa.int64()),
            "b": pa.array([*[None] * len(linked), *b], pa.int64()),
            "n": pa.array([*counts[linked].tolist(), *[None] * len(a)], pa.int64()),
        }
    )


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))


def _beams(graphs: DataFrame, classes: DataFrame, count: int, shards: int) -> DataFrame:
    """dimension, shard, width of the shards with a beam that its probes have shown and no real links speak against.

    A shard with too few real links of its own is judged by those of all shards of its dimension and beam.
    """
    key = ["dimension", "shard"]
    share = min(1.0, AUDIT_ROWS / max(1, count))
    sample = stage(classes.filter(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 20)) < int(share * (1 << 20))), "vector-sample")
    asked = sample.withColumn("shard", _every(shards)).select(*key, "node", "vector")
    wider = F.create_map(*(F.lit(x) for pair in zip(BEAMS, BEAMS[1:]) for x in pair))[F.col("width")]
    alike = Window.partitionBy("dimension", "width")
    own = F.col("wanted") >= AUDIT_LINKS
    wanted, got = (F.when(own, F.col(c)).otherwise(F.sum(c).over(alike)) for c in ("wanted", "got"))
    shown, left = [], graphs.filter("probed > 0 AND piece = 0").select(*key, F.col("probed").alias("width"))
    for _ in BEAMS:
        counted = stage(
            graphs.join(sized(left), key).groupBy(*key).cogroup(asked.groupBy(*key))
            .applyInArrow(_audit, "dimension int, shard int, wanted long, got long"),
            "vector-audit",
        )
        judged = left.join(sized(counted), key, "left").fillna(0, ["wanted", "got"])
        poor = (wanted >= AUDIT_LINKS) & (got < AUDIT_RECALL * wanted)
        judged = stage(judged.withColumn("poor", poor), "vector-beams")
        shown.append(judged.filter("not poor").select(*key, "width"))
        left = judged.filter("poor").select(*key, wider.alias("width")).filter("width is not null")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, shown)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows
    without an id, whose component is null. Only vectors of equal length are compared. Rows that repeat
    both id and vector are one vector, put out each. Ids must be whole numbers; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(id_col).cast("long").alias("node"), F.col(vector_col).cast("array<double>").alias("vector"))
    with scratch(vectors.sparkSession):
        per_node = _linked(rows)
    return rows.select("vec_id", "node").join(per_node, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
        (F.col("node").isNull() | (F.coalesce("component", "node") == F.col("node"))).alias("kept"),
    )


def _linked(rows: DataFrame) -> DataFrame:
    """node, n_links, component of every sound vector; all stages but the result go when it is written."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.filter(F.col("node").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    sound = sound.select("node", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    members = stage(sound.distinct(), "vector-rows")
    classes = stage(
        members.groupBy("vector").agg(F.min("node").alias("node"), F.count("*").alias("copies"))
        .withColumn("dimension", F.size("vector")), "vector-classes",
    )
    # A vector with its links takes about as many bytes as its numbers and 256 more.
    count, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.col("dimension").cast("long") * 8 + 256), F.lit(0))).first()
    shards = max(SHARDS, -(-count // SHARD_ROWS), -(-size // SHARD_BYTES))
    blocks = max(1, -(-count // BLOCK_ROWS), -(-size // BLOCK_BYTES), min(-(-count // LEAST_ROWS), -(-MEETINGS // shards)))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    graphs = stage(
        dealt.groupBy("dimension", "shard").applyInArrow(lambda group: _cut(_build(group)), _PIECES),
        "vector-graphs",
    )
    beams = sized(_beams(graphs, classes, count, shards))
    ready = graphs.join(beams, ["dimension", "shard"], "left").withColumn("width", F.coalesce("width", F.lit(0)))
    asked = classes.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", _every(shards))
    key = ["dimension", "shard", "block"]
    met = stage(
        ready.withColumn("block", _every(blocks)).groupBy(*key)
        .cogroup(asked.select(*key, "node", "vector").groupBy(*key))
        .applyInArrow(_meet, "a long, b long, n long"),
        "vector-links",
    )
    counts = met.filter("n is not null").groupBy(F.col("a").alias("least")).agg(F.sum("n").alias("n"))
    links = met.filter("b is not null").select("a", "b")
    own = stage(members.join(classes.select("vector", F.col("node").alias("least"), "copies"), "vector").select("node", "least", "copies"), "vector-members")
    total = components(links.unionByName(own.select(F.col("node").alias("a"), F.col("least").alias("b"))))
    per_node = (
        own.join(counts, "least", "left")
        .groupBy("node").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .join(total, "node", "left")
    )
    return stage(per_node, "vector-groups", keep=True)
