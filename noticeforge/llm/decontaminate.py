"""Benchmark decontamination: a broadcast hash set of the n-grams of test items, and a scan of all document windows.

Test items are few beside the corpus, but nothing bounds them: their total size is measured. Beyond BLOCK_BYTES of text they are cut into parts of a
sixteenth of that (parts of an item overlap by a window less a word, so no window is lost), whose sizes by bin of a random number tell which bins make up
a block of at most BLOCK_BYTES. Each block is one narrow pass over the documents with its hash set broadcast, as sorted
arrays of about 40 bytes a window; with several blocks each pass is written before the next begins. Documents are never shuffled. A window whose hash is
in the set is compared word by word before it counts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeforge.llm.frames import as_before, map_slices, rest_of, shared_folder, written
from noticeforge.llm.words import ALNUM, LOWER_VALUES, Slice, mix, runs, slices, span_hashes, windows

WINDOW = 13
BLOCK_BYTES = 8 << 20
SPANS = "array<struct<start:long,length:long>>"
#: Values of bytes for a second hash, which tells apart what shares the first, with A-Z read as a-z.
_OTHER_VALUES = mix(LOWER_VALUES ^ np.uint64(0x6A09E667F3BCC909))


class Windows(NamedTuple):
    """The windows of one length: sorted hashes, of each the different windows with it, and of each of those its first word and its items."""

    keys: np.ndarray
    kinds: np.ndarray
    word: np.ndarray
    first: np.ndarray
    item: np.ndarray


class Items(NamedTuple):
    """Items as the bytes of their words one after another, and their windows by length."""

    ids: list[str]
    buf: bytes
    starts: np.ndarray
    ends: np.ndarray
    windows: dict[int, Windows]


def _words(buf: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> bytes:
    return b" ".join(bytes(buf[starts[k] : ends[k]]).lower() for k in range(at, at + n))


def item_windows(items: list[tuple[str, str]], window: int) -> Items:
    """All windows of the items: of `window` words, and of all words of a shorter item."""
    texts = pa.array([t or "" for _, t in items], pa.large_string())
    bufs, starts_, ends_, n_words, n_bytes = [], [], [], 0, 0
    parts: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
    for s in slices(texts):
        starts, ends, first = runs(s, ALNUM)
        sizes = np.minimum(np.diff(first), window)
        one, two = (span_hashes(s.buf, starts, ends, values) for values in (LOWER_VALUES, _OTHER_VALUES))
        for n in np.unique(sizes[sizes > 0]).tolist():
            hashes, at = windows(one, first, n)
            row = np.searchsorted(first, at, side="right") - 1
            own = sizes[row] == n
            parts[n].append((hashes[own], windows(two, first, n)[0][own], s.first + row[own], n_words + at[own]))
        bufs.append(s.buf)
        starts_.append(starts + n_bytes)
        ends_.append(ends + n_bytes)
        n_words, n_bytes = n_words + len(starts), n_bytes + len(s.buf)
    joined = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    found = {}
    for n, rows in parts.items():
        one, two, item, word = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((item, two, one))
        one, two, item, word = one[order], two[order], item[order], word[order]
        kind = np.ones(len(one), bool)
        kind[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        fresh = kind.copy()
        fresh[1:] |= item[1:] != item[:-1]
        at = np.flatnonzero(kind)
        keys, kinds = np.unique(one[at], return_index=True)
        first = np.searchsorted(np.flatnonzero(fresh), np.append(at, len(one)))
        found[n] = Windows(keys, np.append(kinds, len(at)).astype(np.int32), word[at].astype(np.int32), first.astype(np.int32), item[fresh].astype(np.int32))
    return Items([k for k, _ in items], b"".join(x.tobytes() for x in bufs), joined(starts_).astype(np.int32), joined(ends_).astype(np.int32), found)


def item_parts(bench: DataFrame, window: int, part_bytes: int) -> DataFrame:
    """item and text of the items, cut at words into parts of at most part_bytes, or of one window where that is longer; no window is lost and a whole item stays whole."""

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch | None:
        starts, ends, first = runs(s, ALNUM)
        keys, items, texts = batch.column(0).to_pylist(), [], []
        for i in range(len(s)):
            at, last = int(first[i]), int(first[i + 1])
            while at < last:
                to = int(np.searchsorted(ends[:last], starts[at] + part_bytes, side="right"))
                to = min(last, max(to, at + window))
                items.append(keys[i])
                texts.append(s.buf[starts[at] : ends[to - 1]].tobytes().decode("utf-8", "replace"))
                if to == last:
                    break
                at = to - window + 1
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    return map_slices(bench, rows, "item string, text string")


def item_blocks(bench: DataFrame, window: int, block_bytes: int, folder: str) -> list[DataFrame]:
    """The items (item, text) in blocks of at most block_bytes; only a part that is one window can be larger, and then is a block of its own."""
    numbered = item_parts(bench, window, max(1, block_bytes // 16)).withColumn("part", F.monotonically_increasing_id())
    parts = written(numbered, folder, "parts")  # so that numbers last
    size = F.octet_length("text")
    total = parts.agg(F.sum(size)).first()[0] or 0
    bins, blocks, room = max(1, 16 * math.ceil(total / block_bytes)), [], 0
    held = parts.withColumn("bin", F.pmod(F.xxhash64("part"), F.lit(bins)))
    for r in held.groupBy("bin").agg(F.sum(size).alias("n")).orderBy("bin").collect():  # a number of blocks, times 16
        if r.n > block_bytes:  # by a rare chance, or for a window of very long words: its parts one by one
            blocks += [[F.col("part") == x.part] for x in held.where(F.col("bin") == r.bin).select("part").toLocalIterator()]
            room = 0
            continue
        if r.n > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(r.bin)
        room -= r.n
    pick = lambda b: b[0] if isinstance(b[0], Column) else F.col("bin").isin(b)
    return [held.where(pick(b)).select("item", "text") for b in blocks]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: doc_id, text, n_words, n_hit, spans (merged ranges of hit words), items (ids as strings, sorted), contaminated.

    Words are runs of letters, digits and characters outside ASCII, with A-Z lower-cased. An item shorter than the window,
    but not empty, is one window; items without words or with a null text never match; a null item id reads as "null".
    A null or empty document has no words and isn't contaminated. Repeated rows give repeated results; an empty
    items table leaves all documents clean; other columns are ignored, or with keep carried along as the struct `rest`. contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    """
    bench = items.select(F.coalesce(items[item_id].cast("string"), F.lit("null")).alias("item"), F.coalesce(items[item_text].cast("string"), F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_folder(docs.sparkSession) if total > block_bytes else ""
    blocks = item_blocks(bench, window, block_bytes, folder) if folder else [bench]
    state = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), rest_of(docs, id_col, text_col).alias("rest"), F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    if not keep:
        state = state.drop("rest").withColumn("rest", F.lit(0))
    state = state.select("id", "text", "n_words", "spans", "items", "rest")
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = f"id {kinds['id']}, text string, n_words long, spans {SPANS}, items array<string>, rest {kinds['rest']}"
    for block, part in enumerate(blocks):
        table = item_windows([tuple(r) for r in part.collect()], window)  # at most block_bytes, as measured
        state = map_slices(state, _scan(docs.sparkSession.sparkContext.broadcast(table)), schema)
        if block < len(blocks) - 1:
            state = written(state, folder, f"block{block}")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    return state.select(F.col("id").alias("doc_id"), "text", "n_words", n_hit.alias("n_hit"), "spans", "items", *(["rest"] if keep else [])).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _scan(shared):
    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        table: Items = shared.value
        starts, ends, first = runs(s, ALNUM)
        h = span_hashes(s.buf, starts, ends, LOWER_VALUES)
        spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        owners: dict[int, set[str]] = defaultdict(set)
        for n, x in table.windows.items():
            w, at = windows(h, first, n)
            place = np.minimum(np.searchsorted(x.keys, w), len(x.keys) - 1)
            near = np.flatnonzero(x.keys[place] == w)
            for p, k in zip(place[near].tolist(), at[near].tolist()):
                own = _words(s.buf, starts, ends, k, n)
                for kind in range(x.kinds[p], x.kinds[p + 1]):
                    if own == _words(table.buf, table.starts, table.ends, int(x.word[kind]), n):
                        row = int(np.searchsorted(first, k, side="right")) - 1
                        hits[row].append((k - int(first[row]), n))
                        owners[row].update(table.ids[i] for i in x.item[x.first[kind] : x.first[kind + 1]])
        for row, found in hits.items():
            spans[row] = merged([*found, *((x["start"], x["length"]) for x in spans[row])])
            items[row] = sorted(owners[row].union(items[row]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), batch.column(5)], ["id", "text", "n_words", "spans", "items", "rest"])

    return rows


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [{"start": a, "length": b - a} for a, b in out]


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated."""
    found = contamination(docs, items, id_col=id_col, text_col=text_col, keep=True, **options)
    return as_before(found.where(~F.col("contaminated")), docs, {id_col: "doc_id", text_col: "text"})


def cut_spans(found: DataFrame) -> DataFrame:
    """doc_id and text of all rows of contamination(), the hit words taken out of the text, with what stands between the words of a span.

    Texts without hits, null and empty ones stay as they are; repeated rows give repeated results; a null id stays null; an empty table gives no rows.
    """

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        starts, ends, first = runs(s, ALNUM)
        texts = batch.column(1).to_pylist()
        for i, spans in enumerate(batch.column(2).to_pylist()):
            if spans:
                kept, at = [], int(s.offsets[i])
                for x in spans:
                    kept.append(s.buf[at : starts[first[i] + x["start"]]].tobytes())
                    at = int(ends[first[i] + x["start"] + x["length"] - 1])
                texts[i] = b"".join([*kept, s.buf[at : s.offsets[i + 1]].tobytes()]).decode("utf-8", "replace")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_slices(found.select("doc_id", "text", "spans"), rows, f"doc_id {dict(found.dtypes)['doc_id']}, text string")
