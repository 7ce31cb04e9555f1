"""How far the sources of a language differ in their terms, from an index built in a single pass.

Each task reads its documents once and keeps a block of postings - how often a source of a language has a term, and in how many documents -
until BLOCK_POSTINGS of them fill it; the block is then spilled as a run sorted by language and term (terms go in the order of their hashes, which is
the same everywhere and orders shards as well). The hashes are cut into as many shards as the runs need, and a task merges the sorted runs of a
shard with a heap into one posting list a term. Terms that enough documents hold are kept as a table, from which everything else is counted.

The distance of two sources is a sum over all kept terms, but a term that neither holds adds the same to it each time. So a narrow
pass over the posting lists streams corrections only: for each source of a list, what its term adds beyond that. A task keeps
one matrix of the pairs of a block of sources, so no row is made for a pair and a term.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.llm import stores
from noticeforge.llm.frames import shared_folder, written
from noticeforge.llm.words import LETTERS, LOWER_BYTES, LOWER_VALUES, Slice, mix, runs, slices, span_hashes

#: Documents of a language that hold a kept term; what a share of a term is smoothed by; the whole of the shares; ranks of terms.
MIN_DOCS, SMOOTHING, WHOLE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Postings that fill a task's block, which is then spilled as a run; and bytes of the terms with them.
BLOCK_POSTINGS, BLOCK_TERM_BYTES = 1 << 20, 16 << 20
#: Terms of a piece of a run, which is a row; terms that a heap lets through at once; terms of all runs of a shard, about.
PIECE, CHUNK, SHARD_TERMS = 4096, 4096, 1 << 18
#: Sources that a pass pairs with as many others; more sources go in blocks, each pair of blocks a pass.
SOURCES = 512
#: Bytes of the matrices of pairs that a task holds.
PAIR_BYTES = 32 << 20
#: Documents of a source are counted under this term, which no text has.
NO_TERM = ""
POSTINGS = "array<struct<source:string,n:long>>"
#: A piece: terms, each followed by a space, of each its documents and its number of postings, and the postings of all: sources (by their place in `sources`) and occurrences.
PIECES = "lang string, terms string, n_docs array<long>, sizes array<int>, sources array<string>, codes array<int>, counts array<long>"


class Block:
    """Postings of the documents read so far: term hash, group, occurrences, documents; and the terms' letters."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.bytes = 0

    def add(self, s: Slice, groups: list[tuple[str, str]]) -> None:
        """The documents of a slice, of the given (lang, source)."""
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        starts, ends, first = runs(s, LETTERS)
        h = span_hashes(s.buf, starts, ends, LOWER_VALUES)
        row = np.repeat(np.arange(len(s)), np.diff(first))
        order = np.argsort(h, kind="stable")  # words come by rows, so rows of a hash stay in order
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        self.terms.append((h[at], *spans_of(LOWER_BYTES[s.buf], starts[order[at]], (ends - starts)[order[at]])))
        self.bytes += len(self.terms[-1][1])
        new[1:] |= row[1:] != row[:-1]
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(h)))
        g, docs = np.unique(group, return_counts=True)  # all documents of a source stand under the hash 0
        self._keep(np.concatenate([h[at], np.zeros(len(g), np.uint64)]), np.concatenate([group[row[at]], g]), np.concatenate([n, np.zeros(len(g), np.int64)]), np.concatenate([np.ones(len(at), np.int64), docs]))
        if self.size >= BLOCK_POSTINGS or self.bytes >= BLOCK_TERM_BYTES:  # what several slices hold becomes one
            self._settle()

    def _keep(self, h: np.ndarray, g: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        order = np.lexsort((g, h))
        h, g, n, docs = h[order], g[order], n[order], docs[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        self.parts.append((h[at], g[at], np.add.reduceat(n, at), np.add.reduceat(docs, at)))
        self.size += len(at)

    def _settle(self) -> None:
        parts, self.parts, self.size = self.parts, [], 0
        self._keep(*(np.concatenate(x) for x in zip(*parts)))
        hashes, bufs, sizes = (np.concatenate(x) for x in zip(*self.terms))
        hashes, at = np.unique(hashes, return_index=True)
        self.terms = [(hashes, *spans_of(bufs, (np.cumsum(sizes) - sizes)[at], sizes[at]))]
        self.bytes = len(self.terms[0][1])

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_POSTINGS // 2 or self.bytes >= BLOCK_TERM_BYTES // 2

    def run(self) -> list[dict]:
        """The postings as a run, for each language its terms in the order of their keys, in pieces of PIECE of them; the block is empty afterwards."""
        self._settle()
        ((h, g, n, docs),), ((names, letters, sizes),) = self.parts, self.terms
        langs, sources = sorted({x for x, _ in self.groups}), sorted({x for _, x in self.groups})
        to_lang, to_source = ({x: k for k, x in enumerate(own)} for own in (langs, sources))
        lang, source = (np.array([to[x[k]] for x in self.groups])[g] for k, to in enumerate((to_lang, to_source)))
        key = mix(h ^ np.array([lang_salt(x) for x in langs], np.uint64)[lang])
        order = np.lexsort((source, key, lang))
        lang, key, h, source, n, docs = (x[order] for x in (lang, key, h, source, n, docs))
        new = np.ones(len(h), bool)
        new[1:] = (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])
        at = np.flatnonzero(new)
        n_docs, per_term = np.add.reduceat(docs, at), np.diff(np.append(at, len(h)))
        real = h[at] != 0
        place = np.where(real, np.minimum(np.searchsorted(names, h[at]), max(len(names) - 1, 0)), 0)
        begin = np.cumsum(sizes) - sizes
        out = []
        bounds = np.searchsorted(lang[at], np.arange(len(langs) + 1))
        for k, name in enumerate(langs):
            for a in range(bounds[k], bounds[k + 1], PIECE):
                i = slice(a, min(a + PIECE, bounds[k + 1]))
                own = slice(at[i.start], at[i.stop] if i.stop < len(at) else len(h))
                size = np.where(real[i], sizes[place[i]], 0) if len(sizes) else np.zeros(i.stop - i.start, np.int64)
                flat = spans_of(letters, begin[place[i]] if len(sizes) else size, size, 1)[0]
                codes, used = np.unique(source[own], return_inverse=True)
                out.append({"lang": name, "terms": flat.tobytes().decode(), "n_docs": n_docs[i], "sizes": per_term[i], "sources": [sources[c] for c in codes], "codes": used, "counts": n[own]})
        self.clear()
        return out


def spans_of(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, each followed by `gap` spaces, and their sizes."""
    wide = sizes + gap
    to = np.cumsum(wide) - wide
    out = np.full(int(wide.sum()), 32, np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + inside] = buf[np.repeat(starts, sizes) + inside]
    return out, sizes


def lang_salt(lang: str) -> int:
    """A hash of a language, so that equal terms of different languages have keys of their own."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def terms_of(column: pa.Array, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of terms, each followed by a space: all bytes, starts and ends of the terms, their keys, and the row of each. langs: of the rows."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    ends = np.flatnonzero(buf == 32)
    starts = np.append(0, ends + 1)[:-1]
    row = np.searchsorted(offsets - offsets[0], ends, side="right") - 1 if len(column) else ends
    salts = {x: np.uint64(lang_salt(x)) for x in set(langs)}
    h = np.where(ends > starts, span_hashes(buf, starts, ends, LOWER_VALUES), np.uint64(0))
    return buf, starts, ends, mix(h ^ np.array([salts[x] for x in langs], np.uint64)[row]), row


def _pieces(rows: list[dict], more: dict[str, list]) -> pa.RecordBatch:
    names = ["lang", "terms", "n_docs", "sizes", "sources", "codes", "counts"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    extra = [pa.array(v, pa.int64()) for v in more.values()]
    return pa.RecordBatch.from_arrays([*extra, *(pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds))], [*more, *names])


def spilled_runs(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """run, place and the columns of PIECES: pieces of sorted runs, numbered in their run."""
    named = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    df = docs.select(named(lang).alias("lang"), named(source).alias("source"), named(text).alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stores.free()
        number, block = itertools.count(TaskContext.get().partitionId() << 32), Block()

        def spilled() -> Iterator[pa.RecordBatch]:
            run, made = next(number), block.run()
            for k in range(0, len(made), 64):
                part = made[k : k + 64]
                yield _pieces(part, {"run": [run] * len(part), "place": list(range(k, k + len(part)))})

        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for s in slices(batch.column(2)):
                block.add(s, groups[s.first : s.first + len(s)])
                if block.full:
                    yield from spilled()
        if block.parts:
            yield from spilled()

    return df.mapInArrow(step, f"run long, place long, {PIECES}")


def _dealt(bits: int):
    """A step that cuts pieces where their keys pass from one of 2**bits shards to the next. Terms and postings stay where they are; only bounds are new."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                of = {c: part.column(k) for k, c in enumerate(part.schema.names)}
                buf, starts, _, key, row = terms_of(of["terms"], of["lang"].to_pylist())
                shard = (key >> np.uint64(64 - bits)).astype(np.int64)
                cut = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (row[1:] != row[:-1])))
                bounds = np.append(cut, len(key))
                postings = np.append(0, np.cumsum(of["sizes"].flatten().to_numpy()))[bounds]
                text = np.append(starts[cut], len(buf))
                lists = lambda c, to: pa.ListArray.from_arrays(pa.array(to, pa.int32()), of[c].flatten())  # noqa: E731, B023
                rows = pa.array(row[cut])
                terms = pa.StringArray.from_buffers(len(cut), pa.py_buffer(text.astype(np.int32).tobytes()), pa.py_buffer(buf.tobytes()))
                columns = [pa.array(shard[cut]), of["run"].take(rows), of["place"].take(rows), of["lang"].take(rows), terms, lists("n_docs", bounds), lists("sizes", bounds), of["sources"].take(rows), lists("codes", postings), lists("counts", postings)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "run", "place", "lang", "terms", "n_docs", "sizes", "sources", "codes", "counts"])

    return step


class Shard:
    """All runs of a shard: keys and bytes of terms, documents, and postings by the codes of the shard's sources; and where each run of a language begins and ends."""

    def __init__(self, table: pa.Table):
        names, lang = np.unique(np.array(table.column("lang").to_pylist(), object), return_inverse=True)
        order = np.lexsort((table.column("place").to_numpy(), table.column("run").to_numpy(), lang))
        table = table.take(pa.array(order)).combine_chunks()
        of = {c: table.column(c).chunk(0) for c in table.column_names}
        lang, run = lang[order], of["run"].to_numpy()
        self.buf, self.starts, self.ends, self.key, row = terms_of(of["terms"], names[lang].tolist())
        self.docs = of["n_docs"].flatten().to_numpy()
        self.sizes = of["sizes"].flatten().to_numpy().astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.counts = of["counts"].flatten().to_numpy()
        self.sources, code = np.unique(np.array(of["sources"].flatten().to_pylist(), object), return_inverse=True)
        begin = of["sources"].offsets.to_numpy() - of["sources"].offsets[0].as_py()
        self.source = code[np.repeat(begin[:-1][row], self.sizes) + of["codes"].flatten().to_numpy()]
        new = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (run[1:] != run[:-1])))
        bounds = np.searchsorted(row, np.append(new, table.num_rows))
        self.runs: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, a, b in zip(new.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            self.runs[names[lang[k]]].append((a, b))

    def term(self, k: int) -> str:
        return self.buf[self.starts[k] : self.ends[k]].tobytes().decode()


def merged_terms(shard: Shard, runs_: list[tuple[int, int]], min_docs: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Place, documents, codes of sources and occurrences of the terms that min_docs documents hold (and of NO_TERM), from the sorted runs of a language.

    A heap holds for each run the key that its next CHUNK terms end with. The least of these bounds what can be merged: all runs give their
    terms up to it, and nothing later can belong to them.
    """
    at = [a for a, _ in runs_]
    bound_of = lambda k: int(shard.key[min(at[k] + CHUNK, runs_[k][1]) - 1])
    heap = [(bound_of(k), k) for k, (a, b) in enumerate(runs_) if b > a]
    heapq.heapify(heap)
    while heap:
        bound, parts = heap[0][0], []
        for k, (_, end) in enumerate(runs_):
            to = at[k] + int(np.searchsorted(shard.key[at[k] : end], np.uint64(bound), side="right"))
            parts.append(np.arange(at[k], to))
            at[k] = to
        while heap and heap[0][0] <= bound:
            _, k = heapq.heappop(heap)
            if at[k] < runs_[k][1]:
                heapq.heappush(heap, (bound_of(k), k))
        place = np.concatenate(parts)
        _, first, group = np.unique(shard.key[place], return_index=True, return_inverse=True)
        n_docs = np.bincount(group, shard.docs[place], len(first)).astype(np.int64)
        names = place[first]
        kept = np.flatnonzero((n_docs >= min_docs) | (shard.starts[names] == shard.ends[names]))
        some = np.isin(group, kept)
        place, group = place[some], group[some]
        sizes = shard.sizes[place]
        flat = np.repeat(shard.first[place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        of, source, n = np.repeat(group, sizes), shard.source[flat], shard.counts[flat]
        order = np.lexsort((source, of))
        of, source, n = of[order], source[order], n[order]
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (source[1:] != source[:-1])))[: len(of)]
        if len(new):
            n, source, of = np.add.reduceat(n, new), source[new], of[new]
        for k, a, b in zip(kept.tolist(), np.searchsorted(of, kept).tolist(), np.searchsorted(of, kept + 1).tolist()):
            yield names[k], int(n_docs[k]), source[a:b], n[a:b]


def merged_runs(table: pa.Table, min_docs: int) -> pa.Table:
    """lang, term, n_docs and postings of the kept terms of a shard."""
    shard = Shard(table)
    langs, terms, docs, lists, flat, counts = [], [], [], [0], [], []
    for lang, own in shard.runs.items():
        for place, n_docs, source, n in merged_terms(shard, own, min_docs):
            langs.append(lang), terms.append(shard.term(place)), docs.append(n_docs), lists.append(lists[-1] + len(n))
            flat.append(source), counts.append(n)
    joined = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    names = pa.DictionaryArray.from_arrays(pa.array(joined(flat), pa.int32()), pa.array(shard.sources.tolist(), pa.string())).cast(pa.string())
    postings = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays([names, pa.array(joined(counts))], ["source", "n"]))
    return pa.table({"lang": pa.array(langs, pa.string()), "term": pa.array(terms, pa.string()), "n_docs": pa.array(docs, pa.int64()), "postings": postings})


def frequencies(docs: DataFrame, folder: str, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The written table lang, term, n_docs and postings {source, n} of the terms that min_docs documents of a language hold, and one row of NO_TERM a language with all its sources."""
    spilled = written(spilled_runs(docs, lang, source, text), folder, "runs")
    total = spilled.agg(F.sum(F.size("n_docs"))).first()[0] or 0
    least = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // shard_terms)
    bits = max(1, (least - 1).bit_length())
    dealt = spilled.mapInArrow(_dealt(bits), f"shard long, run long, place long, {PIECES}").repartition(1 << bits, "shard")
    return written(dealt.groupBy("shard").applyInArrow(lambda table: merged_runs(table, min_docs), f"lang string, term string, n_docs long, postings {POSTINGS}"), folder, "frequencies")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + SMOOTHING) / (total + SMOOTHING * terms)), in exact decimals."""
    wide = lambda c: c.cast("decimal(38,0)")
    up = F.lit(WHOLE).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(up), wide(total + SMOOTHING * terms))


def shares(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * n / below) of whole numbers, three decimal digits at a time, so that nothing overflows."""
    out, rest = np.divmod(n, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


class Pairs:
    """Sums of corrections of the pairs of two blocks of a language's sources."""

    def __init__(self, one: list[tuple[str, int, int]], two: list[tuple[str, int, int]]):
        self.names, self.place, self.below = [], [], []
        for side in (one, two):
            self.names.append([x[0] for x in side])
            self.place.append({x[0]: k for k, x in enumerate(side)})
            self.below.append(np.array([n + SMOOTHING * terms for _, n, terms in side], np.int64))
        self.sums = np.zeros((len(one), len(two)), np.int64)

    def add(self, lists: list[list[dict]]) -> None:
        """The posting lists of some terms."""
        counts = [np.zeros((len(lists), len(x)), np.int64) for x in self.names]
        for k, postings in enumerate(lists):
            for x in postings:
                for side in (0, 1):
                    at = self.place[side].get(x["source"])
                    if at is not None:
                        counts[side][k, at] = x["n"]
        p = [shares(c + SMOOTHING, b) for c, b in zip(counts, self.below)]
        zero = [shares(np.full(len(b), SMOOTHING, np.int64), b) for b in self.below]
        for i in range(len(self.names[0])):
            base = np.abs(zero[0][i] - zero[1])
            own = np.flatnonzero(counts[0][:, i])
            self.sums[i] += (np.abs(p[0][own, i][:, None] - p[1][own]) - base).sum(axis=0)
        for j in range(len(self.names[1])):  # terms that only the other one holds
            base = np.abs(zero[0] - zero[1][j])
            own = np.flatnonzero(counts[1][:, j])
            self.sums[:, j] += ((np.abs(p[0][own] - p[1][own, j][:, None]) - base) * (counts[0][own] == 0)).sum(axis=0)


def pair_corrections(kept: DataFrame, groups: DataFrame, folder: str, block: int = SOURCES) -> DataFrame:
    """lang, a, b (a < b) and the written sums of what kept terms that one of them holds add to their distance beyond a term that neither has.

    groups: lang, source, total and terms. Up to about `block` of them are broadcast at once, in a pass over the posting lists; more of
    them take a pass for each pair of blocks.
    """
    spark = kept.sparkSession
    n_blocks = max(1, math.ceil(groups.count() / block))
    numbered = written(groups.select("lang", "source", "total", "terms", F.pmod(F.xxhash64("lang", "source"), F.lit(n_blocks)).alias("block")), folder, "blocks")
    found = None
    for i, j in itertools.combinations_with_replacement(range(n_blocks), 2):
        sides: list[dict[str, list]] = [defaultdict(list), defaultdict(list)]
        for side, k in enumerate((i, j)):
            for r in numbered.where(F.col("block") == k).collect():  # distinct groups, dealt by a hash: about `block` rows
                sides[side][r.lang].append((r.source, r.total, r.terms))
        part = written(kept.select("lang", "postings").mapInArrow(_paired(spark.sparkContext.broadcast([dict(x) for x in sides])), "lang string, a string, b string, correction long"), folder, f"pairs{i}-{j}")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))


def _paired(shared):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores.free()
        one, two = shared.value
        held: dict[str, Pairs] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, x in held.items():
                names = [np.array(n, object) for n in x.names]
                # within one block each pair stands twice; across blocks it may be in either order
                i, j = np.nonzero((x.sums != 0) & (names[0][:, None] < names[1][None, :] if x.names[0] == x.names[1] else np.ones(x.sums.shape, bool)))
                a, b = names[0][i], names[1][j]
                low, high = np.where(a < b, a, b), np.where(a < b, b, a)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(low.tolist(), pa.string()), pa.array(high.tolist(), pa.string()), pa.array(x.sums[i, j])], ["lang", "a", "b", "correction"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                lists: dict[str, list] = defaultdict(list)
                part = batch.slice(at, 1024)
                for lang, postings in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang in one and lang in two:
                        lists[lang].append(postings)
                for lang, own in lists.items():
                    if lang not in held:
                        held[lang] = Pairs(one[lang], two[lang])
                    held[lang].add(own)
                if sum(x.sums.nbytes for x in held.values()) > PAIR_BYTES:
                    yield from sums()
        yield from sums()

    return step


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, ranks: int = TERM_RANKS, block: int = SOURCES, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from its others (part pair) and which terms set it apart from the language (part term).

    Null texts, languages and sources read as ''. Terms are runs of letters of ASCII and of characters outside it, with A-Z
    lower-cased; a language keeps those that at least min_docs of its documents hold. A share is 1 + floor(10**9 * (n + 5) / (N + 5 * V)), n a term's
    occurrences in a source (or the language), N those of all V kept terms. pair: for each other source the sum of the
    differences of shares over all kept terms (0 without any), all ranks. term: kept terms of the source whose share is above
    the language's, by the difference, to rank `ranks`. Ranks go down by value, of equal ones up by item. Repeated rows count
    again; a source without terms has its pairs; a language with one source has none; an empty table gives no rows; other
    columns are ignored.
    """
    folder = shared_folder(docs.sparkSession)
    index = frequencies(docs, folder, lang, source, text, min_docs, shard_terms)
    kept = index.where(F.col("term") != NO_TERM)
    flat = kept.select("lang", "term", F.explode("postings").alias("x")).select("lang", "term", "x.source", "x.n")
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum(F.aggregate("postings", F.lit(0).cast("long"), lambda t, x: t + x["n"])).alias("lang_total"))
    per_source = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = index.where(F.col("term") == NO_TERM).select("lang", F.explode("postings.source").alias("source"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = written(every.join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), folder, "groups")

    of_lang = F.aggregate("postings", F.lit(0).cast("long"), lambda t, x: t + x["n"])
    held = kept.select("lang", "term", of_lang.alias("all"), F.explode("postings").alias("x")).select("lang", "term", "all", "x.source", "x.n").where(F.col("n") > 0).join(groups, ["lang", "source"])
    value = _share(F.col("n"), F.col("total"), F.col("terms")) - _share(F.col("all"), F.col("lang_total"), F.col("terms"))
    terms = held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).where(F.col("value") > 0)

    plain = groups.select("lang", "source", "terms", _share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1))).alias("zero"))
    other = plain.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_2"))
    both = plain.join(other, "lang").where(F.col("source") != F.col("item")).withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")})
    corrected = both.join(pair_corrections(kept, groups, folder, block), ["lang", "a", "b"], "left")
    distance = F.col("terms") * F.abs(F.col("zero") - F.col("zero_2")) + F.coalesce("correction", F.lit(0))
    pairs = corrected.select("lang", "source", F.lit("pair").alias("part"), "item", distance.alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
