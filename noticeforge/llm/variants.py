"""Spelling variants of a corpus' words: pairs of words that one edit of a code point tells apart.

Words and their counts come from one narrow pass with counts combined in the task, and one aggregate. Two words with one edit between
them share the code points before and after it: their common prefix and suffix together reach the longer length less one.
So they agree in the first or in the last half of the longer length, and again in a half of what is left: words meet in
buckets of the same length (the longer one's), beginning and end. Buckets of over TILE words are split by halves again until
one place is left, where an alphabet bounds them, so no bucket is ever too large for a task and no word meets
all others. Inside, buckets of one size are compared at once: padded matrices of code points, aligned left and right,
give the common prefixes and suffixes of all pairs of a bucket. Of the buckets that two words share, one counts the pair.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import stores
from noticeforge.llm.frames import keyed_text, shared_folder, written
from noticeforge.llm.words import ASCII_LETTERS, LOWER_BYTES, LOWER_VALUES, Slice, marked_runs, slices, span_hashes

LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: A run loses a code point where its checksum divides by this.
MISPRINT = 199
#: Words, and bytes of them, that a task counts before it passes its counts on.
BLOCK_WORDS, BLOCK_WORD_BYTES = 1 << 18, 16 << 20
#: Most words of a bucket. More than any alphabet of Latin-1 letters and one shorter word.
TILE = 256
#: Code points that are compared at once.
AT_ONCE = 1 << 22
#: Runs of more bytes are checked one by one.
_LONG = 48
_NO_CAP = 1 << 30
_BUCKET = ["m", "lo", "hi", "cap", "key"]

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def latin_runs(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """runs() of A-Z, a-z and U+00C0 to U+00FF, whose two bytes in UTF-8 are C3 and any other."""
    lead = s.buf == 0xC3
    mask = ASCII_LETTERS[s.buf] | lead
    mask[1:] |= lead[:-1]
    return marked_runs(s, mask)


def checksums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of the byte spans, each after bytes whose crc32 is `before`."""
    size = ends - starts
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    left = np.flatnonzero(size <= _LONG)
    state = out[left]
    for k in range(_LONG):
        go = size[left] > k
        out[left[~go]] = state[~go]
        left, state = left[go], state[go]
        if not len(left):
            break
        state = _CRC[(state ^ buf[starts[left] + k]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    out[left] = state
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of the runs of all texts, lower-cased (A-Z) and, by their checksum with the document's id, without one code point; of at least LEAST_LENGTH code points."""
    df = keyed_text(docs, id_col, text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.free()
        counts: dict[int, int] = defaultdict(int)
        names: dict[int, str] = {}
        edited: dict[str, int] = defaultdict(int)
        held = 0

        def block() -> pa.RecordBatch:
            words, n = [*(names[h] for h in counts), *edited], [*counts.values(), *edited.values()]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            heads = [zlib.crc32(f"{x}:".encode()) for x in batch.column(0).to_pylist()]
            for s in slices(batch.column(1)):
                starts, ends, first = latin_runs(s)
                low = LOWER_BYTES[s.buf]
                marks = np.concatenate([[0], np.cumsum(s.buf == 0xC3)])
                length = ends - starts - (marks[ends] - marks[starts])
                row = np.repeat(np.arange(len(s)), np.diff(first))
                some = np.flatnonzero(length >= LEAST_LENGTH)
                starts, ends, length, row = starts[some], ends[some], length[some], row[some]
                crc = checksums(low, starts, ends, np.array(heads[s.first : s.first + len(s)], np.uint32)[row])
                broken = crc % MISPRINT == 0
                for i in np.flatnonzero(broken & (length > LEAST_LENGTH)):
                    word, at = low[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(length[i])
                    edited[word[:at] + word[at + 1 :]] += 1
                    held += len(word)
                whole = np.flatnonzero(~broken)
                h, at, n = np.unique(span_hashes(low, starts[whole], ends[whole], LOWER_VALUES), return_index=True, return_counts=True)
                for x, i, c in zip(h.tolist(), whole[at].tolist(), n.tolist()):
                    if x not in names:
                        names[x] = low[starts[i] : ends[i]].tobytes().decode()
                        held += len(names[x])
                    counts[x] += c
                if len(counts) + len(edited) >= BLOCK_WORDS or held >= BLOCK_WORD_BYTES:
                    yield block()
                    counts.clear(), names.clear(), edited.clear()
                    held = 0
        if counts or edited:
            yield block()

    return df.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row of a bucket in the two buckets of its halves: in the first, words also share the next half of what is left, in the other the last half.

    A pair of the bucket whose common prefix reaches the first half counts there; any other (`cap`) has its edit before it and shares the last half.
    """
    half = F.floor((F.col("m") - F.col("lo") - F.col("hi")) / 2).cast("int")
    sides = F.array(
        F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"), F.col("cap").alias("cap")),
        F.struct(F.col("lo").alias("lo"), (F.col("hi") + half).alias("hi"), (F.col("lo") + half).alias("cap")),
    )
    cut = rows.select("word", "n", "m", F.explode(sides).alias("x")).select("word", "n", "m", "x.*")
    ends = F.struct(F.substring("word", F.lit(1), F.col("lo")), F.right("word", F.col("hi")))
    return cut.withColumn("key", F.xxhash64("m", "lo", "hi", "cap", ends))


def _matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (Latin-1 bytes) aligned left and right, padded with 0, and lengths."""
    length = np.array([len(w) for w in words])
    width = int(length.max(initial=1))
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    left[row, place] = flat
    right[row, length[row] - 1 - place] = flat
    return left, right, length


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading code points of the rows of a and b, which are broadcast against each other."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=-1), same.shape[-1], np.argmin(same, axis=-1))


def near_in_buckets(words: list[bytes], rank: np.ndarray, m: np.ndarray, lo: np.ndarray, cap: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its near words in its bucket and the smallest rank of these (-1 if none). Buckets of the given sizes follow each other."""
    n_near, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    first = np.cumsum(sizes) - sizes
    lengths = np.array([len(w) for w in words])
    widest = np.maximum.reduceat(lengths, first) if len(first) else first
    for size in np.unique(sizes[sizes > 1]).tolist():
        which = np.flatnonzero(sizes == size)
        which = which[np.argsort(widest[which], kind="stable")]
        at = 0
        while at < len(which):
            to, width = at + 1, int(widest[which[at]])
            while to < len(which) and (to + 1 - at) * size * size * int(widest[which[to]]) <= AT_ONCE:
                to += 1
            rows = first[which[at:to]][:, None] + np.arange(size)
            flat = rows.ravel()
            left, right, length = _matrices([words[k] for k in flat])
            shape = (to - at, size)
            left, right, length, width = left.reshape(*shape, -1), right.reshape(*shape, -1), length.reshape(shape), left.shape[-1]
            step = max(1, AT_ONCE // max(1, (to - at) * size * width))
            for k in range(0, size, step):  # some words of each bucket against all of it
                i = slice(k, k + step)
                begin = _shared(left[:, i, None, :], left[:, None, :, :])
                end = _shared(right[:, i, None, :], right[:, None, :, :])
                longer = np.maximum(length[:, i, None], length[:, None, :])
                own = rows[:, i]
                near = (begin + end >= longer - 1) & (longer == m[own][:, :, None]) & (begin >= lo[own][:, :, None]) & (begin < cap[own][:, :, None])
                near &= own[:, :, None] != rows[:, None, :]
                n_near[own] = near.sum(axis=2)
                least = np.where(near, rank[rows][:, None, :], np.iinfo(np.int64).max).min(axis=2)
                best[own] = np.where(near.any(axis=2), least, -1)
            at = to
    return n_near, best


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best {n, word} of the words with a near one, from rows that come sorted by bucket."""
    stores.free()
    left: pa.Table | None = None

    def compared(x: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        names, n = x.column("word").to_pylist(), x.column("n").to_numpy()
        order = np.array(sorted(range(len(names)), key=lambda k: (-n[k], names[k])))
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        m, lo, cap = (x.column(c).to_numpy() for c in ("m", "lo", "cap"))
        n_near, best = near_in_buckets([w.encode("latin-1") for w in names], rank, m, lo, cap, np.diff(starts))
        hit = np.flatnonzero(n_near)
        to = order[best[hit]]
        found = pa.StructArray.from_arrays([pa.array(n[to]), pa.array([names[k] for k in to], pa.string())], ["n", "word"])
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in hit], pa.string()), pa.array(n_near[hit]), found], ["word", "n_near", "best"])

    def cut(x: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        new = np.ones(x.num_rows, bool)
        new[1:] = np.any([(c := x.column(k).to_numpy())[1:] != c[:-1] for k in _BUCKET], axis=0)
        starts = np.append(np.flatnonzero(new), x.num_rows)
        if not last:
            starts = starts[:-1]
        whole = x.slice(0, int(starts[-1])) if len(starts) else x.slice(0, 0)
        return (compared(whole, starts) if whole.num_rows else None), None if last else x.slice(int(starts[-1])).combine_chunks()

    for batch in batches:
        if batch.num_rows:
            x = pa.Table.from_batches([batch])
            out, left = cut(pa.concat_tables([left, x]) if left is not None else x, False)
            if out is not None and out.num_rows:
                yield out
    if left is not None and left.num_rows:
        out, _ = cut(left, True)
        if out is not None and out.num_rows:
            yield out


def near_words(words: DataFrame, folder: str, tile: int = TILE) -> DataFrame:
    """word, n_near and best {n, word}, the near word of largest n (of equal ones the first in code-point order), of the words that have any. words: word, n, distinct, of Latin-1 letters."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    start = words.select("word", "n", longer).withColumns({"lo": F.lit(0), "hi": F.lit(0), "cap": F.lit(_NO_CAP)})
    todo, found, level = _halved(_halved(start)), None, 0
    while todo is not None:
        # a bucket with one free place is bounded by the alphabet; sizes are few rows
        open_ = F.col("m") - F.col("lo") - F.col("hi") > 1
        large = written(todo.groupBy(*_BUCKET).agg(F.count(F.lit(1)).alias("size")).where(open_ & (F.col("size") > tile)), folder, f"large{level}")
        if large.isEmpty():
            now, todo = todo, None
        else:
            # a large bucket's rows are dealt to tasks by their words
            deals = 64
            dealt = todo.withColumn("_deal", F.pmod(F.xxhash64("word"), F.lit(deals)))
            marks = large.select(*_BUCKET, F.explode(F.expr(f"sequence(0L, {deals - 1}L)")).alias("_deal"))
            now = dealt.join(marks, [*_BUCKET, "_deal"], "left_anti").drop("_deal")
            todo = written(_halved(dealt.join(marks, [*_BUCKET, "_deal"], "left_semi")), folder, f"halved{level}")
        near = written(now.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET).mapInArrow(_tiles, "word string, n_near long, best struct<n:long,word:string>"), folder, f"near{level}")
        found = near if found is None else found.unionByName(near)
        level += 1
    # the best: the largest n, then the first word, as a minimum of (-n, word)
    least = F.min(F.struct((-F.col("best.n")).alias("minus"), F.col("best.word").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("x")).select("word", "n_near", F.struct((-F.col("x.minus")).alias("n"), F.col("x.word").alias("word")).alias("best"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word and root, the last of the forms that follow from it, of a table of words and their forms. Counts grow along forms, so there are no circles and few steps."""
    up = written(forms.select("word", F.col("form").alias("root")), folder, "root0")
    level = 0
    while True:
        level += 1
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = written(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"root{level}")
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR, tile: int = TILE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF of all texts, with A-Z lower-cased, as word_counts() gives them: where the crc32 of
    `<id>:<run>` divides by MISPRINT, without the code point at its remainder by the length. Those of at least LEAST_LENGTH code
    points and least_count occurrences count. n_near: words one inserted, deleted or replaced code point away. form: the near word with
    the largest n (of equal ones the first in code-point order) if that is at least factor times n, else null; root: the last of the forms that
    follow, the word itself without any. Null and empty texts have no words; a null id reads as an empty one; repeated rows
    count again; an empty table gives no rows; other columns are ignored.
    """
    folder = shared_folder(docs.sparkSession)
    words = written(word_counts(docs, id_col, text_col).where(F.col("n") >= least_count), folder, "words")
    near = near_words(words, folder, tile)
    fits = F.col("best.n") >= factor * F.col("n")
    found = written(words.join(near, "word", "left").select("word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.n")).alias("form_n")), folder, "found")
    last = roots(found.where(F.col("form").isNotNull()), folder)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
