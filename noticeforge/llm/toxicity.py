"""Toxicity by a counterfactual-regularised linear classifier.

Features of a text are its words and their beginnings (present or not), as hashes. The classifier is fitted on at most
TRAIN_ROWS labelled rows, those with the smallest hash of their id: Spark counts in how many toxic and other
rows of them each feature stands, keeps the FEATURES most telling, and the driver fits a logistic regression over the
rows' kept features. For each row that mentions a group, the text is made once more with each mention swapped for
another of its kind, and half COUNTERFACTUAL times the squared change of the score is added to the loss, so that mentions
alone don't move a score. Scoring is one narrow pass over all whole texts with the weights broadcast (at most
FEATURES of them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm import stores
from noticeforge.llm.frames import keyed_text, map_slices, remainder_of_five, shared_folder, written
from noticeforge.llm.identity_terms import ADJECTIVE, NOUN, PERSONS
from noticeforge.llm.words import ALNUM, LOWER_VALUES, Slice, mix, runs, slices, span_hashes

TRAIN_ROWS = 24_000
FEATURES = 4_096
#: Bytes of the word beginnings that are features besides the words.
PREFIXES = (5, 6, 7, 8)
#: Rows of the sample in which a feature stands at least, and its least G statistic.
MIN_ROWS, MIN_G = 4, 20.0
COUNTERFACTUAL, L2, STEPS = 1.0, 1e-4, 400
#: Counterfactuals of a row.
TWINS = 2
MODEL = "feature long, weight double"


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of all rows, each once a row and sorted by row, and where each row's begin."""
    starts, ends, first = runs(s, ALNUM)
    row = np.repeat(np.arange(len(s)), np.diff(first))
    hashes, rows = [span_hashes(s.buf, starts, ends, LOWER_VALUES)], [row]
    for n in PREFIXES:
        long = ends - starts > n
        hashes.append(mix(span_hashes(s.buf, starts[long], starts[long] + n, LOWER_VALUES) + np.uint64(n)))
        rows.append(row[long])
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[fresh], r[fresh]
    return h, np.searchsorted(r, np.arange(len(s) + 1))


def swapped(text: str, turn: int = 1) -> str | None:
    """The text with each group mention swapped for the one `turn` places on in its set; None if nothing changes.

    Sets hold terms of one language, number and part of speech; adjectives are mentions only before a word for persons.
    """
    import re

    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    out, at = [], 0
    for k, m in enumerate(words):
        word = m[0].lower()
        others = NOUN.get(word)
        if others is None and k + 1 < len(words) and words[k + 1][0].lower() in PERSONS and text[m.end() : words[k + 1].start()] in (" ", "-"):
            others = ADJECTIVE.get(word)
        if others and turn <= len(others):
            out += [text[at : m.start()], others[turn - 1]]
            at = m.end()
    return "".join([*out, text[at:]]) if out else None


def twins(text: str) -> list[str]:
    """Up to TWINS different counterfactuals of a text."""
    found = (swapped(text, k) for k in range(1, TWINS + 1))
    return list(dict.fromkeys(x for x in found if x is not None))


def _mentions(s: Slice) -> np.ndarray:
    """Rows that mention a group."""
    names = next(slices(pa.array(sorted({*NOUN, *ADJECTIVE}), pa.string())))
    starts, ends, _ = runs(names, ALNUM)
    known = np.sort(span_hashes(names.buf, starts, ends, LOWER_VALUES))
    starts, ends, first = runs(s, ALNUM)
    at = np.flatnonzero(np.isin(span_hashes(s.buf, starts, ends, LOWER_VALUES), known))
    return np.unique(np.searchsorted(first, at, side="right") - 1)


def training_rows(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, text and y of at most `most` labelled rows that aren't held out; their ids are broadcast, bounded by `most`."""
    ids = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    ids = ids.where(remainder_of_five(F.col("id")) != 0).groupBy("id").agg(F.max("y").alias("y"))
    picked = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    return keyed_text(docs, id_col, text_col).join(F.broadcast(picked), "id")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[int, float]]:
    """(feature, weight) pairs; feature 0 is the bias. Without labelled rows of both kinds only a bias comes back."""
    # the sample is bounded; read again from its own table, not from the corpus
    rows = written(training_rows(docs, labels, most, id_col, text_col, label_col), shared_folder(docs.sparkSession), "sample")

    def count(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        h, at = features(s)
        y = np.repeat(np.asarray(batch.column(2)) > 0, np.diff(at))
        unique, back = np.unique(h, return_inverse=True)
        n = np.bincount(back, minlength=len(unique))
        toxic = np.bincount(back, weights=y, minlength=len(unique)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(toxic), pa.array(n.astype(np.int64) - toxic)], ["feature", "toxic", "other"])

    sizes = dict(rows.groupBy("y").count().collect())
    n1, n0 = sum(n for y, n in sizes.items() if y > 0), sum(n for y, n in sizes.items() if y <= 0)
    if not n1 or not n0:
        return [(0, 4.0 if n1 else -4.0)]
    counts = map_slices(rows.select("id", "text", "y"), count, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).where(F.col("a") + F.col("b") >= MIN_ROWS)
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (n1 + n0)
    g = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    best = counts.select("feature", g.alias("g")).where(F.col("g") >= MIN_G).orderBy(F.desc("g"), "feature").limit(FEATURES)
    kept = np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64))
    shared = rows.sparkSession.sparkContext.broadcast(kept)

    def active(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        kept = shared.value
        own, other = picked(s, kept), [[] for _ in range(len(s))]
        for i in _mentions(s):
            other[i] = [picked(next(slices(pa.array([text], pa.string()))), kept)[0] for text in twins(s.text(int(i)))]
        return pa.RecordBatch.from_arrays([batch.column(2), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.list_(pa.int32())))], ["y", "own", "twins"])

    found = map_slices(rows.select("id", "text", "y"), active, "y int, own array<int>, twins array<array<int>>").toPandas()  # at most TRAIN_ROWS rows of kept features
    order = sorted(range(len(found)), key=lambda i: (found["y"][i], list(found["own"][i])))  # the same sums whatever the order of arrival
    w, bias = solve([found["own"][i] for i in order], [found["twins"][i] for i in order], np.array([found["y"][i] > 0 for i in order], float), len(kept))
    return [(0, float(bias)), *zip(kept.view(np.int64).tolist(), w.tolist())]


def picked(s: Slice, kept: np.ndarray) -> list[np.ndarray]:
    """For each row the places in `kept` of the features that it has."""
    h, at = features(s)
    if not len(kept):
        return [np.zeros(0, np.int32)] * len(s)
    k = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
    hit = kept[k] == h
    to = np.concatenate([[0], np.cumsum(hit)])[at]
    k = k[hit].astype(np.int32)
    return [k[to[i] : to[i + 1]] for i in range(len(s))]


def solve(own: list, twins_: list, y: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the logistic loss, L2 and the counterfactual penalty over each row and its twins."""
    flat = lambda rows: (np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in rows)]), np.repeat(np.arange(len(rows)), [len(x) for x in rows]))
    f, r = flat(own)
    pairs = [(a, b) for a, others in zip(own, twins_) for b in others]
    fa, ra = flat([a for a, _ in pairs])
    fb, rb = flat([b for _, b in pairs])
    w, bias = np.zeros(n + 1), 0.0
    w[n] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(r, weights=w[f], minlength=len(y)) + w[n]
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(f, weights=miss[r], minlength=n)[:n], miss.sum())
        if pairs:
            gap = COUNTERFACTUAL * (np.bincount(ra, weights=w[fa], minlength=len(pairs)) - np.bincount(rb, weights=w[fb], minlength=len(pairs))) / len(pairs)
            grad[:n] += np.bincount(fa, weights=gap[ra], minlength=n)[:n] - np.bincount(fb, weights=gap[rb], minlength=n)[:n]
        grad[:n] += L2 * w[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    z = np.bincount(r, weights=w[f], minlength=len(y)) + w[n]
    return w[:n], w[n] - cut_point(z, y)


def cut_point(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between scores that makes the fewest errors, the one nearest to 0 among equals."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edge = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    middle = (edge[:-1] + edge[1:]) / 2
    real = np.append(True, np.append(np.diff(z) > 1e-9, True))
    best = np.flatnonzero(real & (errors == errors[real].min()))
    return float(middle[best[np.argmin(np.abs(middle[best]))]])


def toxicity(docs: DataFrame, model: list[tuple[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row by the fitted (feature, weight) pairs.

    Only the text is an input. A null or empty text scores the bias alone; repeated rows score alike; other columns
    are ignored; an empty table gives no rows.
    """
    keyed = keyed_text(docs, id_col, text_col)
    return keyed.select(F.col("id").alias("doc_id"), scorer(docs.sparkSession, model)("text").alias("score"))


def accepted(docs: DataFrame, model: list[tuple[int, float]], limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns and repeated rows, whose score is under the limit; null and empty texts have the bias for a score."""
    return docs.where(scorer(docs.sparkSession, model)(docs[text_col].cast("string")) < limit)


def scorer(spark: SparkSession, model: list[tuple[int, float]]) -> Callable[..., Column]:
    """A function of a text column, its score: texts go to Python workers once, in Arrow batches, and only the scores come back."""
    bias = next(w for f, w in model if f == 0)
    rest = sorted((np.uint64(f & 0xFFFFFFFFFFFFFFFF), w) for f, w in model if f != 0)
    shared = spark.sparkContext.broadcast((bias, np.array([f for f, _ in rest], np.uint64), np.array([w for _, w in rest])))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stores.free()
        bias, kept, weights = shared.value
        for column in texts:
            z = np.array([bias + weights[k].sum() for s in slices(column) for k in picked(s, kept)], np.float64)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return score
