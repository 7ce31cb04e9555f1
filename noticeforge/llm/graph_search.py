"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard, searched with a beam.

Equal vectors are one node with the few smallest ids that a result can hold. Nodes are dealt by a hash to shards of about SHARD_ROWS, and
a task builds the graph of a shard: nodes enter in rounds that double; a greedy beam search over the graph so far proposes
neighbours of each, and robust pruning keeps the nearest of them while it drops those that are nearer, by the factor ALPHA, to one that it kept,
so that the edges left lead in different directions. Edges go both ways and are pruned again where a node has too many. All searches of a
round go step by step together, as matrix operations.

A shard's vectors and edges are one row of the index, written to the shared folder. Queries go in blocks of bounded size: each is
broadcast to one narrow pass over the shards, in which a beam search runs in every shard and what it finds is compared again in double
precision. Only the best few of a query and shard are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.llm import stores
from noticeforge.llm.frames import shared_folder, written

#: Nodes of a shard, about.
SHARD_ROWS = 8192
#: Edges that pruning leaves a node; edges that it may have before it is pruned again.
DEGREE, MOST_EDGES = 32, 48
#: Factor of robust pruning, on squared distances.
ALPHA = 1.2
#: Nodes that a beam keeps when neighbours are proposed and when queries are answered; nodes that a step opens at once.
BUILD_BEAM, SEARCH_BEAM, WIDTH = 48, 128, 4
#: Queries of a block.
QUERY_BLOCK = 4096
#: Searches that go together.
TOGETHER = 256
INDEX = "shard int, dim int, kind string, n int, vectors binary, edges binary, entry int, ids array<array<long>>"


class Graph:
    """A directed graph over unit vectors, grown by insertion in rounds."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        self.edges = np.full((n, MOST_EDGES), -1, np.int32)
        self.size = np.zeros(n, np.int64)
        middle = self.vectors.mean(axis=0, dtype=np.float64).astype(np.float32)
        self.entry = int(np.argmax(self.vectors @ middle)) if n else -1

    @classmethod
    def of(cls, vectors: np.ndarray, edges: np.ndarray, entry: int) -> Graph:
        self = cls.__new__(cls)
        self.vectors, self.edges, self.entry = np.ascontiguousarray(vectors, np.float32), edges, entry
        return self

    def search(self, queries: np.ndarray, beam: int, opened: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1: none) and squared distances of the beam of each query, nearest first; with `opened`, those of all nodes that the search opened as well, unsorted."""
        n, q = len(self.vectors), len(queries)
        rows = np.arange(q)[:, None]
        ids, dist = np.full((q, beam), -1, np.int64), np.full((q, beam), np.inf, np.float32)
        done = np.ones((q, beam), bool)
        seen = np.zeros((q, n), bool)
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        dist[:, 0] = 2 - 2 * queries @ self.vectors[self.entry]
        trail_ids, trail_dist = [], []
        live = np.arange(q)
        while len(live):
            at = rows[: len(live)]
            i, d, f = ids[live], dist[live], done[live]
            pick = np.argsort(np.where(f, np.inf, d), axis=1, kind="stable")[:, :WIDTH]
            fresh = ~f[at, pick]
            f[at, pick] = True
            some = np.where(fresh, i[at, pick], -1)
            if opened:
                trail = np.full((q, WIDTH), -1, np.int64), np.full((q, WIDTH), np.inf, np.float32)
                trail[0][live], trail[1][live] = some, np.where(fresh, d[at, pick], np.inf)
                trail_ids.append(trail[0]), trail_dist.append(trail[1])
            near = np.where(some[:, :, None] >= 0, self.edges[some], -1).reshape(len(live), -1).astype(np.int64)
            r, c = np.nonzero((near >= 0) & ~seen[live[:, None], near])
            key, first = np.unique(r * n + near[r, c], return_index=True)  # a node that two of the opened ones name counts once
            r, c = r[first], c[first]
            node = near[r, c]
            seen[live[r], node] = True
            new = np.full(near.shape, np.inf, np.float32)
            new[r, c] = 2 - 2 * np.einsum("ij,ij->i", queries[live[r]], self.vectors[node])
            all_ids, all_dist, all_done = np.hstack([i, near]), np.hstack([d, new]), np.hstack([f, np.zeros(near.shape, bool)])
            keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_dist, keep, 1), axis=1, kind="stable"), 1)
            d = np.take_along_axis(all_dist, keep, 1)
            ids[live], dist[live] = np.where(np.isinf(d), -1, np.take_along_axis(all_ids, keep, 1)), d
            done[live] = np.take_along_axis(all_done, keep, 1) | np.isinf(d)
            live = live[(~done[live]).any(axis=1)]
        if opened:
            return np.hstack([ids, *trail_ids]), np.hstack([dist, *trail_dist])
        return ids, dist

    def pruned(self, nodes: np.ndarray, near: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """At most DEGREE neighbours of each node among its candidates (-1: none), nearest first: one that a kept one is nearer to, by ALPHA, is left out."""
        near = near.copy()
        dist = np.where((near < 0) | (near == nodes[:, None]), np.inf, dist)
        order = np.argsort(dist, axis=1, kind="stable")
        near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
        by_id = np.argsort(near, axis=1, kind="stable")  # repeated candidates count once
        again = np.zeros(near.shape, bool)
        ids = np.take_along_axis(near, by_id, 1)
        np.put_along_axis(again, by_id[:, 1:], ids[:, 1:] == ids[:, :-1], 1)
        dist[again] = np.inf
        near[np.isinf(dist)] = -1
        keep = min(near.shape[1], 4 * DEGREE)
        order = np.argsort(dist, axis=1, kind="stable")[:, :keep]
        near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
        x = self.vectors[near]
        between = 2 - 2 * np.matmul(x, x.transpose(0, 2, 1))
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        alive = np.isfinite(dist)
        rows = np.arange(len(nodes))
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            at = np.argmax(alive, axis=1)  # candidates are sorted: the first that is left is the nearest
            out[some, k] = near[rows, at][some]
            alive &= ~(some[:, None] & (ALPHA * between[rows, at] <= dist))
            alive[rows, at] = False
        return out

    def insert(self, nodes: np.ndarray) -> None:
        for k in range(0, len(nodes), TOGETHER):
            own = nodes[k : k + TOGETHER]
            near, dist = self.search(self.vectors[own], BUILD_BEAM, opened=True)
            self.edges[own, :DEGREE] = self.pruned(own, near, dist)
            self.edges[own, DEGREE:] = -1
            self.size[own] = (self.edges[own] >= 0).sum(axis=1)
        to = self.edges[nodes, :DEGREE]
        self.link(to[to >= 0].astype(np.int64), np.repeat(nodes, (to >= 0).sum(axis=1)))

    def link(self, source: np.ndarray, target: np.ndarray) -> None:
        """Edges from source to target; a node that has too many then is pruned."""
        order = np.argsort(source, kind="stable")
        source, target = source[order], target[order]
        fresh = ~(self.edges[source] == target[:, None]).any(axis=1)
        source, target = source[fresh], target[fresh]
        nodes, first, count = np.unique(source, return_index=True, return_counts=True)
        fits = self.size[nodes] + count <= MOST_EDGES
        place = np.arange(len(source)) - np.repeat(first, count) + np.repeat(self.size[nodes], count)
        easy = np.repeat(fits, count)
        self.edges[source[easy], place[easy]] = target[easy]
        self.size[nodes[fits]] += count[fits]
        full, first, count = nodes[~fits], first[~fits], count[~fits]
        for k in range(0, len(full), TOGETHER):
            own, width = full[k : k + TOGETHER], int(count[k : k + TOGETHER].max())
            more = np.full((len(own), width), -1, np.int64)
            for i, (a, c) in enumerate(zip(first[k : k + TOGETHER], count[k : k + TOGETHER])):
                more[i, :c] = target[a : a + c]
            near = np.hstack([self.edges[own].astype(np.int64), more])
            if near.shape[1] > 8 * MOST_EDGES:  # the nearest first, in bounded matrices
                near = self._nearest(own, near, 8 * MOST_EDGES)
            dist = 2 - 2 * np.einsum("ij,ikj->ik", self.vectors[own], self.vectors[near])
            self.edges[own, :DEGREE] = self.pruned(own, near, dist)
            self.edges[own, DEGREE:] = -1
            self.size[own] = (self.edges[own] >= 0).sum(axis=1)

    def _nearest(self, nodes: np.ndarray, near: np.ndarray, n: int) -> np.ndarray:
        out = np.full((len(nodes), n), -1, np.int64)
        for i, node in enumerate(nodes):
            own = np.unique(near[i][near[i] >= 0])
            best = own[np.argsort(-(self.vectors[own] @ self.vectors[node]), kind="stable")[:n]]
            out[i, : len(best)] = best
        return out

    def connect(self) -> None:
        """Edges to nodes that the entry doesn't reach, from the nearest ones that it does; these may have the last place of a node."""
        while True:
            reached = np.zeros(len(self.vectors), bool)
            front = np.array([self.entry])
            while len(front):
                reached[front] = True
                to = self.edges[front]
                front = np.unique(to[to >= 0])
                front = front[~reached[front]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            lost = lost[:TOGETHER]
            near, _ = self.search(self.vectors[lost], BUILD_BEAM)
            for node, own in zip(lost.tolist(), near.tolist()):
                with_room = [x for x in own if x >= 0 and self.size[x] < MOST_EDGES]
                if with_room:
                    at = with_room[0]
                else:  # a chain of nodes without room: behind any reached one that has some
                    room = np.flatnonzero(reached & (self.size < MOST_EDGES))
                    at = int(room[np.argmax(self.vectors[room] @ self.vectors[node])])
                self.edges[at, self.size[at]] = node
                self.size[at] += 1


def built(vectors: np.ndarray) -> Graph:
    """The graph of the rows of a matrix of unit vectors."""
    graph = Graph(vectors)
    order = np.random.default_rng(len(vectors)).permutation(len(vectors))
    order = order[order != graph.entry]
    at = 0
    while at < len(order):
        to = min(len(order), max(2 * at, 32))
        graph.insert(order[at:to])
        at = to
    if len(vectors):
        graph.connect()
    return graph


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b: each from its two rows alone, so that equal rows give equal ones."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def with_direction(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v, an array<float> or array<double>, of the vectors that have a direction, each (id, vector) once."""
    kind = dict(vectors.dtypes)[vector]
    v = vectors[vector] if kind in ("array<float>", "array<double>") else vectors[vector].cast("array<double>")
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(vectors[vec_id].cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(whole).distinct()


def index(vectors: DataFrame, folder: str, k: int, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The written index: one row a shard and length of vectors, with the graph of its nodes and of each node the k + 1 smallest ids."""
    given = with_direction(vectors, vec_id, vector)
    kind = "float64" if dict(given.dtypes)["v"] == "array<double>" else "float32"
    # of equal vectors a result holds the smallest ids only: k, and one more where the query is among them
    few = given.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    nodes = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), folder, "nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    dealt = nodes.withColumns({"dim": F.size("v"), "shard": F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")}).repartition(shards, "shard", "dim")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = table.column("ids").combine_chunks()
        order = np.argsort(ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()], kind="stable")  # whatever the order of the rows, the graph is the same
        v, ids = v[order], ids.take(pa.array(order))
        graph = built(units(v.astype(np.float64)))
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "kind": [kind], "n": pa.array([len(v)], pa.int32()),
            "vectors": [v.astype(kind).tobytes()], "edges": [graph.edges.tobytes()], "entry": pa.array([graph.entry], pa.int32()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
        })

    return written(dealt.groupBy("shard", "dim").applyInArrow(build, INDEX), folder, "index")


def _found(x: dict, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int, beam: int) -> pa.RecordBatch | None:
    """The k best of each query of the block in a shard of the index."""
    dim, n = x["dim"], x["n"]
    if dim not in block:
        return None
    names, queries = block[dim]
    original = np.frombuffer(x["vectors"], x["kind"]).reshape(n, dim).astype(np.float64)
    ids = x["ids"]
    count = np.array([len(i) for i in ids])
    flat, first = np.array([i for own in ids for i in own], np.int64), np.cumsum(count) - count
    unit = units(original).astype(np.float32)
    graph = Graph.of(unit, np.frombuffer(x["edges"], np.int32).reshape(n, MOST_EDGES), x["entry"])
    out = []
    for at in range(0, len(names), TOGETHER):
        q, own = queries[at : at + TOGETHER], names[at : at + TOGETHER]
        if n <= beam:  # all of a small shard
            near = np.broadcast_to(np.arange(n), (len(q), n))
        else:
            near, _ = graph.search(units(q).astype(np.float32), beam)
        row, place = np.nonzero(near >= 0)
        node = near[row, place]
        score = cosines(q[row], original[node])
        times = count[node]
        row, score = np.repeat(row, times), np.repeat(score, times)
        vec = flat[np.repeat(first[node] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        other = vec != own[row]
        row, score, vec = row[other], score[other], vec[other]
        order = np.lexsort((-score, vec, row))  # an id counts once, with its best vector
        row, score, vec = row[order], score[order], vec[order]
        new = np.append(True, (row[1:] != row[:-1]) | (vec[1:] != vec[:-1]))[: len(row)]
        row, score, vec = row[new], score[new], vec[new]
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((own[row[rank < k]], vec[rank < k], score[rank < k]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])


def _searched(shared, k: int, beam: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.free()
        for batch in batches:
            for i in range(batch.num_rows):
                out = _found(batch.slice(i, 1).to_pylist()[0], shared.value, k, beam)
                if out is not None:
                    yield out

    return step


def nearest(queries: DataFrame, shards: DataFrame, folder: str, k: int, beam: int = SEARCH_BEAM, query_id: str = "query_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found in an index of each query, by cosine, ties to the smaller id.

    Queries go in blocks of about `block`, each a narrow pass over the index whose results are written; a beam search runs in every shard.
    """
    spark = queries.sparkSession
    given = with_direction(queries, query_id, vector).groupBy("id").agg(F.min("v").alias("v"))
    named = written(given, folder, "queries")
    n_blocks = max(1, math.ceil(named.count() / block))
    dealt = written(named.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), folder, "blocks") if n_blocks > 1 else named.withColumn("block", F.lit(0))
    found = None
    for b in range(n_blocks):
        rows = dealt.where(F.col("block") == b).select("id", "v").collect()  # distinct ids dealt by a hash: about `block` of them
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r.v), []).append(r)
        shared = spark.sparkContext.broadcast({dim: (np.array([r.id for r in own], np.int64), np.array([r.v for r in own], np.float64)) for dim, own in by_dim.items()})
        part = written(shards.mapInArrow(_searched(shared, k, beam), "query_id long, vec_id long, score double"), folder, f"found{b}")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 5, is_query: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (the cosine of the original vectors, in double precision) of the k nearest found of each query among all other rows.

    Queries are the rows that is_query takes (all without one). The result is approximate; shards of up to `beam` nodes are compared
    whole, so small tables are exact. Null vectors and ids, vectors of zeros, and those with null or non-finite components take no part, nor do
    empty ones; vectors of different lengths aren't compared. Repeated rows count once. An id with several vectors is named
    once in a result, with its best one; as a query its first vector in Spark's order counts, and none of its own rows
    is a candidate. Fewer candidates than k give them all. An empty table gives no rows; other columns are ignored.
    """
    folder = shared_folder(vectors.sparkSession)
    shards = index(vectors, folder, k, vec_id, vector, shard_rows)
    asked = (vectors if is_query is None else vectors.where(is_query)).select(vectors[vec_id].alias("query_id"), vectors[vector].alias("embedding"))
    return nearest(asked, shards, folder, k, beam, block=block)
