"""Substring deduplication by sliding sentence spans.

A text is cut into sentences. From every sentence on, and up to every sentence, the shortest run of at least RUN sentences
and RUN_WORDS words is hashed over its words; runs are matched over the whole corpus, and the sentences of every run that
isn't the first of its hash (smallest id, then place) go. A sentence without an end in sight is cut after words
that their own hash chooses, so that copies are cut alike wherever they start. Repeats within a slice of a task's texts are settled there, so that of each hash
one row a slice is shuffled at most, however many documents hold it; what is shuffled is hashes and places, once. Texts move once, to be
rewritten.

With `passages`, every run of PASSAGE words that stands elsewhere before goes as well, wherever it starts and ends. The smallest
hash among its runs of SEED words, which any copy has too, leads to the copies; the consecutive runs of PASSAGE words with one such seed are a
block. Blocks whose seed repeats are compared whole, and of each kind of block one is compared run by run. A seed that holds over one in HOT of these
blocks, so at most HOT of them, is dealt to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.llm.frames import keyed_text, map_slices, shared_folder, written
from noticeforge.llm.words import ALNUM, LOWER_VALUES, Slice, mix, runs, span_hashes

RUN, RUN_WORDS = 3, 20
#: Words of the shortest passage that is found wherever it starts and ends, and of the seeds by which it is found.
PASSAGE, SEED = 50, 20
RUN_BYTES = 6
#: Words from which a sentence may be cut after a word whose hash says so, one in so many.
LONG, CUT_ONE_IN = 24, 8
#: A seed is hot with over one in HOT of the rows, and HOT_ROWS at least.
HOT, HOT_ROWS = 1_000, 1_000

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def sentences(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: numbers of the first words of sentences (one more at the end), where each row's sentences begin, and
    word starts, ends and hashes. A sentence ends with the word before a mark of _END."""
    starts, ends, first = runs(s, ALNUM)
    h = span_hashes(s.buf, starts, ends, LOWER_VALUES)
    marks = np.concatenate([[0], np.cumsum(_END[s.buf], dtype=np.int64)])
    n = len(starts)
    new = np.zeros(n, bool)
    if n:
        new[1:] = marks[starts[1:]] > marks[ends[:-1]]
        new[first[:-1][first[:-1] < n]] = True
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        cut = (h % np.uint64(CUT_ONE_IN) == 0) & (np.arange(n) - begin >= 0)
        lengths = np.diff(np.concatenate([np.flatnonzero(new), [n]]))
        long = np.repeat(lengths > LONG, lengths)
        new[1:] |= (cut & long)[:-1]
    at = np.flatnonzero(new)
    return np.concatenate([at, [n]]), np.searchsorted(at, first), starts, ends, h


def sentence_runs(sent: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs and the numbers of their first and after-last sentences."""
    n = len(sent) - 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.arange(n)
    row = np.searchsorted(first, k, side="right") - 1
    # forward: the first end with enough words and sentences; backward: the last start
    to = np.maximum(np.searchsorted(sent, sent[:-1] + RUN_WORDS), k + RUN)
    ok = to <= first[row + 1]
    back = np.minimum(np.searchsorted(sent, sent[1:] - RUN_WORDS, side="right") - 1, k + 1 - RUN)
    ok_back = back >= first[row]
    a = np.concatenate([k[ok], back[ok_back]])
    b = np.concatenate([to[ok], k[ok_back] + 1])
    both = np.unique(a * (n + 1) + b)
    a, b = both // (n + 1), both % (n + 1)
    return _hasher(h)(sent[a], sent[b]), a, b


def _hasher(h: np.ndarray):
    """A function of lo and hi: hashes of the words from lo up to hi, as one polynomial, from prefix sums."""
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), _BASE, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), _INVERSE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:-1])])
    return lambda lo, hi: mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def passage_runs(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of PASSAGE words of one row: numbers of their first words, their hashes, their seeds' hashes and places."""
    k = np.arange(len(h) - SEED + 1)
    many = PASSAGE - SEED + 1
    if len(k) < many:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = _hasher(h)
    # the last smallest of `many` seeds in a row: two equal passages of a text never share its place
    seed, place, width = hashes(k, k + SEED), k, 1
    while width < many:
        step = min(width, many - width)
        later = seed[step:] <= seed[:-step]
        seed, place = np.where(later, seed[step:], seed[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(seed))
    at = at[at + PASSAGE <= first[row[: len(seed)] + 1]]
    return at, hashes(at, at + PASSAGE), seed[at], place[at]


def row_order(ids: pa.Array, keys: pa.Array) -> np.ndarray:
    """The number of each row of a slice among its different (id, key), in order."""
    names = list(zip(ids.to_pylist(), keys.to_pylist()))
    number = {name: k for k, name in enumerate(sorted(set(names)))}
    return np.array([number[name] for name in names], np.int64)


def not_first(hashes: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which of the occurrences have a place after the first one of their hash."""
    out = np.zeros(len(hashes), bool)
    _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[back] > 1)
    some = some[np.lexsort((*(x[some] for x in reversed(place)), hashes[some]))]
    new = np.ones(len(some), bool)
    new[1:] = hashes[some][1:] != hashes[some][:-1]
    head = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    out[some] = np.any([x[some] != x[head] for x in place], axis=0)
    return out


def covered(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the intervals from a to b cover, cut where rows begin."""
    edge = np.zeros(first[-1] + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    row_start = np.zeros(first[-1] + 1, bool)
    row_start[first] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | row_start))
    return start, np.flatnonzero(inside[:-1] & (~inside[1:] | row_start))


_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: What tells rows apart and orders them: the id, and 32 bits of a hash of the text, as ids may repeat.
ROW = ["id", "key"]


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and key of the rows with an id."""
    return keyed_text(docs, id_col, text_col).where(F.col("id").isNotNull()).withColumn("key", F.hash("text"))


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hash, id, key, a and b (first and after-last sentence, from 0) of every run of every row with an id that isn't known to be repeated; of
    those that are, what they cover, with `gone` and any hash."""
    df = _named(docs, id_col, text_col)

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        sent, first, _, _, h = sentences(s)
        hashes, a, b = sentence_runs(sent, first, h)
        row = np.searchsorted(first, a, side="right") - 1
        again = not_first(hashes, row_order(batch.column(0), batch.column(2))[row], a - first[row], b - first[row])
        start, end = covered(a[again], b[again], first)
        hashes = np.concatenate([hashes[~again], mix(start.astype(np.uint64) + np.uint64(batch.column(2)[0].as_py() & 0xFFFFFFFF))])
        a, b = np.concatenate([a[~again], start]), np.concatenate([b[~again], end])
        row = np.searchsorted(first, a, side="right") - 1
        named = [batch.column(k).take(pa.array(row)) for k in (0, 2)]
        gone = np.arange(len(a)) >= len(a) - len(start)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *named, pa.array((a - first[row]).astype(np.int32)), pa.array((b - first[row]).astype(np.int32)), pa.array(gone)], ["hash", *ROW, "a", "b", "gone"])

    return map_slices(df, rows, f"hash long, id {dict(df.dtypes)['id']}, key int, a int, b int, gone boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, a and b of every run that isn't the first of its hash."""
    place = [*ROW, "a", "b"]
    ranked = occurrences(docs, id_col, text_col).withColumn("n", F.rank().over(Window.partitionBy("hash").orderBy(*place)))
    return ranked.where(F.col("gone") | (F.col("n") > 1)).select(*place)


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """seed, id, key, a (first word) and runs (RUN_BYTES bytes of the hash of each run of PASSAGE words, which tell the runs of one seed apart) of every block of runs
    that aren't known to be repeated; of those that are, what they cover, with `gone` (the after-last word) and any seed."""
    df = _named(docs, id_col, text_col)

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        starts, ends, first = runs(s, ALNUM)
        at, hashes, seed, place = passage_runs(first, span_hashes(s.buf, starts, ends, LOWER_VALUES))
        row = np.searchsorted(first, at, side="right") - 1
        again = not_first(hashes, row_order(batch.column(0), batch.column(2))[row], at - first[row])
        start, end = covered(at[again], at[again] + PASSAGE, first)
        at, hashes, seed, place = (x[~again] for x in (at, hashes, seed, place))
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        data = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, -RUN_BYTES:])
        offsets = (RUN_BYTES * np.concatenate([begin, np.full(len(start) + 1, len(at))])).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        seeds = np.concatenate([seed[begin], mix(start.astype(np.uint64) + np.uint64(batch.column(2)[0].as_py() & 0xFFFFFFFF))])
        head = np.concatenate([at[begin], start])
        row = np.searchsorted(first, head, side="right") - 1
        named = [batch.column(k).take(pa.array(row)) for k in (0, 2)]
        gone = np.concatenate([np.full(len(begin), -1), end - first[row[len(begin) :]]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), *named, pa.array((head - first[row]).astype(np.int32)), packed, pa.array(gone)], ["seed", *ROW, "a", "runs", "gone"])

    return map_slices(df, rows, f"seed long, id {dict(df.dtypes)['id']}, key int, a int, runs binary, gone int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, a and b (first and after-last word, from 0) of runs of PASSAGE words or more, each of whose runs of PASSAGE words isn't the first of its hash."""
    found = blocks(docs, id_col, text_col)
    spark = docs.sparkSession
    folder, tasks = shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, place = F.count(F.lit(1)), F.struct(*ROW, "a")
    size = F.floor(F.length("runs") / RUN_BYTES).cast("int")
    many = written(found.groupBy("seed").agg(n.alias("n")).where(F.col("n") > 1), folder, "seeds")
    least = max((many.agg(F.sum("n")).first()[0] or 0) / HOT, HOT_ROWS)
    hot = [r.seed for r in many.where(F.col("n") > least).collect()]  # at most HOT

    def met(rows: DataFrame, seeds: DataFrame, by: list[str]) -> DataFrame:
        """rows with `met` where their seed is among `seeds`; those of a hot seed are dealt by `by`."""
        is_hot = F.col("seed").isin(hot)
        deal = F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(tasks)).cast("int")).otherwise(0) if hot else F.lit(0)
        every = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
        return rows.withColumn("deal", deal).join(seeds.select("seed", every.alias("deal"), F.lit(True).alias("met")), ["seed", "deal"], "left").drop("deal")

    kept = met(found, many, ROW).where(F.col("met") | (F.col("gone") >= 0)).drop("met")
    again = written(kept.withColumn("block", F.xxhash64("runs")), folder, "blocks")
    settled = again.where(F.col("gone") >= 0).select(*ROW, "a", F.col("gone").alias("b"))
    again = again.where(F.col("gone") < 0)
    kinds = written(again.groupBy("seed", "block").agg(F.min(place).alias("first"), n.alias("n"), F.first("runs").alias("runs")), folder, "kinds")
    copies = again.select("seed", "block", *ROW, "a", (F.col("a") + size + PASSAGE - 1).alias("b")).join(kinds.where(F.col("n") > 1).select("seed", "block", "first"), ["seed", "block"])
    # a copied block goes whole; the first of each kind is compared with the other kinds of its seed
    several = kinds.groupBy("seed").agg(n.alias("n")).where(F.col("n") > 1)
    each = met(kinds, several, ["block"]).where("met").select("seed", "first", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring("runs", i * RUN_BYTES + 1, F.lit(RUN_BYTES)))).alias("k", "run"))
    each = each.select("seed", "run", *(F.col("first")[c].alias(c) for c in ROW), (F.col("first.a") + F.col("k")).alias("a"))
    key = ["seed", "run"]
    first = each.groupBy(*key).agg(F.min(place).alias("first"), n.alias("n")).where(F.col("n") > 1).drop("n")
    single = each.join(first, key).where(place != F.col("first")).select(*ROW, "a", (F.col("a") + PASSAGE).alias("b"))
    return copies.where(place != F.col("first")).select(*ROW, "a", "b").unionByName(single).unionByName(settled)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """One row per input row: doc_id, text without its repeated sentences, n_sentences, n_removed, removed (their numbers' ranges).

    Words are runs of letters, digits and characters outside ASCII, with A-Z as a-z; marks and white space between them don't
    matter for a match. A sentence goes with all up to the next one's first word. Null texts stay null and texts without
    words as they are; rows with a null id are left alone; rows that share an id are texts of their own, and those
    that share the text as well keep the sentences that one of them holds first. An empty table gives no rows; other columns are ignored. With `passages`, words of repeated_passages()
    go as well, and sentences that lose some of their words count as removed.
    """
    spans = repeated_spans(docs, id_col, text_col).withColumn("words", F.lit(False))
    if passages:
        spans = spans.unionByName(repeated_passages(docs, id_col, text_col).withColumn("words", F.lit(True)))
    spans = spans.groupBy(*ROW).agg(F.collect_list(F.struct("words", "a", "b")).alias("spans"))
    df = keyed_text(docs, id_col, text_col).withColumn("key", F.hash("text"))
    kind = dict(df.dtypes)["id"]

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        sent, first, starts, _, _ = sentences(s)
        texts, gone = batch.column(1).to_pylist(), []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            n = int(first[i + 1] - first[i])
            at = sent[first[i] : first[i + 1] + 1] - sent[first[i]]
            out = np.zeros(at[-1] + 1, bool)
            for x in spans or ():
                a, b = (x["a"], x["b"]) if x["words"] else (at[min(x["a"], n)], at[min(x["b"], n)])
                out[a : min(b, at[-1])] = True
            hit = np.logical_or.reduceat(out[:-1], at[:-1]) if n else np.zeros(0, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            gone.append([{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            if n and hit.any():
                # bytes at which words begin: the first takes what stands before it
                begin = np.concatenate([[s.offsets[i]], starts[sent[first[i]] + 1 : sent[first[i + 1]]], [s.offsets[i + 1]]])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8)])))
                kept, done = [], 0
                for a, b in zip(edge[::2], edge[1::2]):
                    kept.append(s.buf[begin[done] : begin[a]].tobytes())
                    done = b
                texts[i] = b"".join([*kept, s.buf[begin[done] : begin[-1]].tobytes()]).decode("utf-8", "replace")
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        removed = [sum(r["b"] - r["a"] for r in x) for x in gone]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(gone, span)], ["doc_id", "text", "n_sentences", "n_removed", "removed"])

    return map_slices(df.join(spans, ROW, "left").select("id", "text", "spans"), rows, f"doc_id {kind}, text string, n_sentences long, n_removed long, removed array<struct<a:int,b:int>>")
