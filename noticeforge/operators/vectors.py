"""Approximate vector recall by coarse cells; evaluation.vector_topk() is the exact way.

Centres are fitted on a bounded sample, every vector is put into the cell of its nearest centre, and a query looks into the cells of its nearest
centres only. How many are needed is measured on the sample, against its exact answers. Cells are cut into parts of bounded size, and the
queries that look into a cell as well; each pair of such parts is one matrix product in a task, so that all queries take one pass over
the vectors, and neither a large cell nor one that many queries want falls to a single task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.sources.folders import staged

#: Rows of the sample; most centres; rounds of fitting; sampled queries by which probes are chosen.
SAMPLE, MOST_CELLS, ROUNDS, TRIALS = 20_000, 4_096, 12, 200
#: Vectors, and queries, of a part of a cell.
PART_ROWS, QUERY_ROWS = 16_384, 1_024
RECALL = 0.97


class Cells(NamedTuple):
    """Centres as unit rows, and the number of nearest ones that a query looks into."""

    centres: np.ndarray
    probes: int


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """i and v of the vectors that have a direction."""
    v = F.col(vector).cast("array<double>")
    return vectors.select(F.col(vec_id).alias("i"), v.alias("v")).where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def fit_cells(vectors: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", cells: int | None = None, recall: float = RECALL, sample: int = SAMPLE) -> Cells | None:
    """Centres and probes from `sample` vectors by the smallest hashes of their ids; None without any vector.

    There are about the square root of the vectors' number of cells, unless told. Probes are the fewest cells that give `recall` of the k nearest
    within the sample, over TRIALS of its vectors.
    """
    rows = usable(vectors, vec_id, vector)
    n = rows.count()
    if not n:
        return None
    m = _unit(np.array([r.v for r in rows.orderBy(F.xxhash64("i"), "i").limit(sample).collect()], np.float64))
    count = max(1, min(cells or math.isqrt(n), MOST_CELLS, len(m)))
    centres = m[np.random.default_rng(n).permutation(len(m))[:count]]
    for _ in range(ROUNDS):
        near = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        centres = np.where(full[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centres)
    near = np.argmax(m @ centres.T, axis=1)
    tried = m[:TRIALS]
    s = tried @ m.T
    s[np.arange(len(tried)), np.arange(len(tried))] = -2
    best = np.argsort(-s, axis=1, kind="stable")[:, : min(k, max(len(m) - 1, 1))]
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell among a query's nearest
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1
    return Cells(centres, probes)


def _celled(rows: DataFrame, shared, many: bool) -> DataFrame:
    """rows (i, v) with the cell of each, or with `many` in each of the cells that it looks into."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, probes = shared.value
        for batch in batches:
            if batch.num_rows:
                m = np.array(batch.column(1).to_pylist(), np.float64)
                s = _unit(m) @ centres.T
                cell = np.argsort(-s, axis=1, kind="stable")[:, : probes if many else 1]
                row = pa.array(np.repeat(np.arange(len(m)), cell.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(cell.ravel().astype(np.int32))], ["i", "v", "cell"])

    return rows.mapInArrow(step, f"i {dict(rows.dtypes)['i']}, v array<double>, cell int")


def _parts(rows: DataFrame, size: int) -> DataFrame:
    """cell and the number of parts of about `size` rows that it takes."""
    return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))


def probed_topk(queries: DataFrame, vectors: DataFrame, k: int, cells: Cells | None = None, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding", part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, vec_id, cosine (6 places) and rank of the k most similar other vectors in the cells that each query looks into.

    Null and zero vectors have no direction and aren't compared. Ids are whole numbers. A query whose cells hold fewer than k others gets fewer.
    """
    cells = cells or fit_cells(vectors, k, vec_id, vector)
    schema = "query_id long, vec_id long, cosine double"
    spark = vectors.sparkSession
    if cells is None:
        return spark.createDataFrame([], f"{schema}, rank int")
    shared = spark.sparkContext.broadcast(tuple(cells))
    held, asked = staged(_celled(usable(vectors, vec_id, vector), shared, False)), staged(_celled(usable(queries, query_id, vector), shared, True))
    hold, ask = _parts(held, part_rows).toDF("cell", "n_part"), _parts(asked, query_rows).toDF("cell", "n_ask")
    both = hold.join(ask, "cell")
    dealt = lambda c, salt: F.pmod(F.xxhash64("i", F.lit(salt)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = held.join(both, "cell").withColumn("part", dealt("n_part", 1)).withColumn("ask", every("n_ask")).select("cell", "part", "ask", "i", "v")
    right = asked.join(both, "cell").withColumn("ask", dealt("n_ask", 2)).withColumn("part", every("n_part")).select("cell", "part", "ask", "i", "v")

    def compared(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, names = a.column("i").to_numpy(), b.column("i").to_numpy()
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())}
        if not len(ids) or not len(names):
            return pa.table(empty)
        m, q = (_unit(np.array(x.column("v").to_pylist(), np.float64)) for x in (a, b))
        out = []
        for at in range(0, len(q), 256):
            cos = np.round(q[at : at + 256] @ m.T, 6)
            cos[names[at : at + 256, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, cos.shape), -cos), axis=1)[:, :k]
            best = np.take_along_axis(cos, order, 1)
            row, place = np.nonzero(best > -np.inf)
            out.append((names[at + row], ids[order[row, place]], best[row, place]))
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(empty, zip(*out))})

    place = ["cell", "part", "ask"]
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(compared, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact results (query_id, vec_id) there are, and the share of them that was found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
