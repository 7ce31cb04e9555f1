"""Graph search against brute force: recall, exact scores, order, and awkward vectors."""

import collections
import math

import numpy as np
import pytest

from noticeforge.llm import graph_search as G

SF = "/root/testdata/sf0.1"


def cosine(a, b):
    a, b = np.array(a, np.float64), np.array(b, np.float64)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def expected(rows, queries, k=5):
    """All pairs; rows: (id, vector)."""
    out = {}
    for q, v in queries:
        best = {}
        for i, w in rows:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -2), cosine(v, w))
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [x for x, _ in a[q]] == [x for x, _ in b[q]], q
        assert all(math.isclose(x, y, abs_tol=1e-12) for (_, x), (_, y) in zip(a[q], b[q]))


def recall(got, want):
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    return hits / sum(len(x) for x in want.values())


@pytest.mark.parametrize("shard_rows", [8192, 600])
def test_recall_on_the_given_table(spark, shard_rows):
    """Whole table in one shard, and in several; queries in several blocks as well."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    names, m = np.array([i for i, _ in rows]), G.units(np.array([v for _, v in rows], np.float64))
    want = {}
    for q in np.flatnonzero(names % 50 == 0):
        s = m @ m[q]
        s[q] = -2
        want[int(names[q])] = [(int(names[j]), float(s[j])) for j in np.lexsort((names, -s))[:5]]
    got = found(G.nearest_neighbours(table, 5, table["vec_id"] % 50 == 0, shard_rows=shard_rows, block=16))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert recall(got, want) >= 0.95
    of = dict(rows)
    for q, own in got.items():
        assert [x for x, _ in own] == [x for x, _ in sorted(own, key=lambda x: (-x[1], x[0]))] and q not in dict(own)
        assert all(math.isclose(s, cosine(of[q], of[x]), abs_tol=1e-12) for x, s in own)


def test_recall_of_a_large_graph():
    """Clustered vectors with many near copies: every node is reached, and most neighbours are found."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    v = np.vstack([centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 32)) * 0.7, centres[:1] + rng.normal(size=(1500, 32)) * 1e-3, centres[1:2] * rng.uniform(1, 2, 1500)[:, None]])
    u = G.units(v).astype(np.float32)
    graph = G.built(u)
    reached, front = set(), {graph.entry}
    while front:
        reached |= front
        front = {x for k in front for x in graph.edges[k].tolist() if x >= 0} - reached
    assert len(reached) == len(u)
    q = np.arange(0, 3000, 30)
    near, dist = graph.search(u[q], G.SEARCH_BEAM)
    assert (np.diff(dist, axis=1) >= 0).all()
    best = np.argsort(-(u[q] @ u.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(near.tolist(), best.tolist())]) > 0.9


def test_pruning_by_its_definition():
    rng = np.random.default_rng(4)
    u = G.units(rng.normal(size=(200, 8))).astype(np.float32)
    graph = G.Graph(u)
    near = np.array([rng.choice(200, 60) for _ in range(20)])
    d = lambda a, b: 2 - 2 * float(u[a] @ u[b])
    dist = np.array([[d(k, x) for x in near[k]] for k in range(20)], np.float32)
    for k, out in enumerate(graph.pruned(np.arange(20), near, dist).tolist()):
        left, want = sorted(set(near[k].tolist()) - {k}, key=lambda x: d(k, x)), []
        while left and len(want) < G.DEGREE:
            want.append(left[0])
            left = [x for x in left[1:] if G.ALPHA * d(want[-1], x) > d(k, x)]
        assert [x for x in out if x >= 0] == want


def test_awkward_vectors(spark):
    """Nulls, zeros, infinities, other lengths, copies, scaled copies, huge and tiny components, repeated ids: small tables are exact."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(1, 40)]
    rows += [(100 + k, [1.0, 2.0, 3.0, 4.0]) for k in range(30)] + [(200 + k, [2.0**k, 2.0 ** (k + 1), 3 * 2.0**k, 2.0 ** (k + 2)]) for k in range(4)]
    rows += [(300, [1e300, 0.0, 0.0, 0.0]), (301, [1e-300, 0.0, 0.0, 0.0]), (302, [1.0, 2.0]), (303, [2.0, 1.0]), (5, [9.0, 9.0, 9.0, 9.0])]
    bad = [(400, None), (401, [0.0] * 4), (402, [1.0, None, 2.0, 3.0]), (403, [1.0, float("nan"), 2.0, 3.0]), (404, [float("inf"), 1.0, 1.0, 1.0]), (405, []), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows + bad + rows[:3]], "vec_id long, embedding array<double>, score string, rank int")
    scaled = [(i, (np.array(v) / max(abs(x) for x in v)).tolist()) for i, v in rows]
    first = {}
    for i, v in sorted(rows, key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    queries = [(i, (np.array(v) / max(abs(x) for x in v)).tolist()) for i, v in first.items()]
    same(found(G.nearest_neighbours(df, 5)), expected(scaled, queries))
    some = G.nearest_neighbours(df, 3, df["vec_id"] % 2 == 0)
    assert found(some).keys() == {i for i in first if i % 2 == 0}
    assert G.nearest_neighbours(df.limit(0)).count() == 0
    assert found(G.nearest_neighbours(df.where("vec_id = 1"))) == {}


def test_a_third_of_all_vectors_equal(spark):
    """Equal vectors are one node; ties go to the smaller ids, whatever their number."""
    rng = np.random.default_rng(8)
    copies = [(k * 3, [1.0, 1.0, 0.0]) for k in range(700)]
    others = [(k * 3 + 1, rng.normal(size=3).tolist()) for k in range(700)]
    df = spark.createDataFrame(copies + others, "vec_id long, embedding array<float>").repartition(7)
    got = found(G.nearest_neighbours(df, 5, df["vec_id"].isin([0, 9, 1500, 1501 // 3 * 3 + 1]), shard_rows=500))
    assert [x for x, _ in got[0]] == [3, 6, 9, 12, 15] and [x for x, _ in got[9]] == [0, 3, 6, 12, 15] and [x for x, _ in got[1500]] == [0, 3, 6, 9, 12]
