"""Evaluation: golden differences, precision at k, score versions, tasks, tools; vector recall and capped reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.sources.folders import staged

#: Query vectors of one block; a block is one pass over the vectors with the block broadcast.
QUERY_BLOCK = 4096
#: Vectors that are compared with a block at once.
CHUNK = 512


def golden_diff(expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every key of either side with its kind: equal, different, missing or unexpected; null equals null."""
    e = expected.select(*keys, *(F.col(c).alias(f"expected_{c}") for c in columns), F.lit(True).alias("_e"))
    a = actual.select(*keys, *(F.col(c).alias(f"actual_{c}") for c in columns), F.lit(True).alias("_a"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"expected_{c}").eqNullSafe(F.col(f"actual_{c}"))
    kind = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(same, "equal").otherwise("different")
    return e.join(a, keys, "full").withColumn("kind", kind).drop("_e", "_a")


def golden_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def precision_at_k(ranked: DataFrame, labels: DataFrame, key: str, by: str, order: list[Column], k: int = 20) -> DataFrame:
    """Per `by`: share of relevant rows among the first k labelled ones, and the share of relevant rows that these miss."""
    rows = ranked.join(labels, key)
    w = Window.partitionBy(by).orderBy(*order)
    # the first k by themselves: Spark keeps k rows of a task, so a large `by` isn't sorted in one place
    best = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy(by).agg(F.count(F.lit(1)).alias("n_top"), F.round(F.avg("relevant"), 4).alias("precision"), F.sum("relevant").alias("_found"))
    total = rows.groupBy(by).agg(F.sum("relevant").alias("_all"))
    return total.join(best, by).select(by, "n_top", "precision", F.round((F.col("_all") - F.col("_found")) / F.when(F.col("_all") != 0, F.col("_all")), 4).alias("missed"))


def compare_versions(matches: DataFrame, first: str, second: str) -> DataFrame:
    """Per position the scores of two versions, their change and the shift of rank; one aggregate, no self join."""
    pick = lambda v: F.max(F.when(F.col("score_version") == v, F.col("score")))
    return compare_scores(matches.groupBy("position_id").agg(pick(first).alias("score_1"), pick(second).alias("score_2")))


def compare_scores(both: DataFrame) -> DataFrame:
    """The change and the shift of rank of rows position_id, score_1 and score_2, which are written once, as the ranks read them too."""
    both = staged(both.select("position_id", "score_1", "score_2"))
    # ranks are counts of better scores: a small histogram instead of a window over all rows
    out = both.withColumn("change", F.col("score_2") - F.col("score_1"))
    for c in ("score_1", "score_2"):
        levels = both.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col(c).isNotNull())
        rank = F.coalesce(F.sum("n").over(Window.orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
        out = out.join(levels.select(c, rank.alias(f"rank_{c}")), c, "left")
    return out.select("position_id", "score_1", "score_2", "change", (F.col("rank_score_1") - F.col("rank_score_2")).alias("rank_shift"))


def task_success(tasks: DataFrame) -> DataFrame:
    """Per kind: tasks, success share, and read-only tasks that wrote."""
    broke = (F.col("kind") == "query") & F.col("wrote")
    return tasks.groupBy("kind").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg(F.col("success").cast("int")), 4).alias("success_rate"), F.count_if(broke).alias("violations"))


def tool_audit(calls: DataFrame, exact: bool = False) -> DataFrame:
    p95 = F.percentile("duration_ms", 0.95) if exact else F.percentile_approx("duration_ms", 0.95)
    return calls.groupBy("tool", "status").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.round(p95, 4).alias("p95_ms"))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, cosine (6 places) and rank of the k most similar other vectors of each query, exactly.

    Queries go in blocks of QUERY_BLOCK, each broadcast; a task compares a batch of vectors with a block in one matrix product
    and passes on only its best k of each query, so what is shuffled doesn't grow with pairs. Null and zero vectors have
    no direction and aren't compared.
    """
    spark = queries.sparkSession
    numbered = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    n_blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    parts = []
    for b in range(n_blocks):
        rows = numbered.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).collect()  # about QUERY_BLOCK rows
        parts.append(_block_topk(spark, rows, vectors.select(F.col(vec_id).alias("i"), F.col(vector).alias("v")), k))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(cos: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row, of equal ones those with the smaller id."""
    if cos.shape[1] > k:
        least = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
        keep = int((cos >= least).sum(axis=1).max())  # more than k only with ties
        some = np.argpartition(-cos, keep - 1, axis=1)[:, :keep]
        cos, ids = np.take_along_axis(cos, some, 1), np.take_along_axis(ids, some, 1)
    order = np.lexsort((ids, -cos), axis=1)[:, :k]
    return np.take_along_axis(cos, order, 1), np.take_along_axis(ids, order, 1)


def _block_topk(spark, rows: list, vectors: DataFrame, k: int) -> DataFrame:
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = [r for r in rows if any(r.v)]
    shared = spark.sparkContext.broadcast(([r.q for r in rows], unit(np.array([r.v for r in rows], np.float64)) if rows else np.zeros((0, 1))))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        names = np.array(names, np.int64)
        best_cos, best_id = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows or not len(names):
                continue
            m = batch.column(1).values.to_numpy(zero_copy_only=False)[batch.column(1).offsets[0].as_py() :].astype(np.float64).reshape(-1, q.shape[1])
            i = np.asarray(batch.column(0))
            some = np.linalg.norm(m, axis=1) > 0
            m, i = unit(m[some]), i[some]
            for at in range(0, len(i), CHUNK):
                part = i[at : at + CHUNK]
                cos = np.round(q @ m[at : at + CHUNK].T, 6)
                cos[names[:, None] == part[None, :]] = -np.inf
                best_cos, best_id = _best(np.hstack([best_cos, cos]), np.hstack([best_id, np.broadcast_to(part, cos.shape)]), k)
        row, place = np.nonzero(best_cos > -np.inf)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(best_id[row, place]), pa.array(best_cos[row, place])], ["query_id", "vec_id", "cosine"])

    return vectors.mapInArrow(step, "query_id long, vec_id long, cosine double")


def recall_gain(base: DataFrame, candidate: DataFrame, by: str) -> DataFrame:
    """Per `by`: precision of two result lists (by, relevant) and their difference."""
    p = lambda df, name: df.groupBy(by).agg(F.avg(F.col("relevant").cast("int")).alias(name))
    both = p(base, "base_precision").join(p(candidate, "candidate_precision"), by, "full")
    return both.select(by, F.round("base_precision", 4).alias("base_precision"), F.round("candidate_precision", 4).alias("candidate_precision"), F.round(F.col("candidate_precision") - F.col("base_precision"), 4).alias("gain"))


def rerank_top_n(candidates: DataFrame, scores: DataFrame, by: str, key: str, order: list[Column], n: int, budget: float) -> DataFrame:
    """The first n of each `by`, reordered by a supplied score as far as the cost so far allows; the others keep their place behind."""
    w = Window.partitionBy(by).orderBy(*order)
    top = candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).join(scores, key, "left")
    before = F.coalesce(F.sum("cost").over(Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scored = top.withColumn("reranked", (before < budget) & F.col("rerank_score").isNotNull())
    final = Window.partitionBy(by).orderBy(F.desc("reranked"), F.when(F.col("reranked"), -F.col("rerank_score")), "place")
    return scored.withColumn("final_place", F.row_number().over(final))
