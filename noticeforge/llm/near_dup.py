"""Near-duplicate groups by HyperMinHash, with exact verification.

A document's set is its distinct word shingles. Its sketch has one register a bucket: each shingle's 64-bit hash chooses
a bucket and offers the place of the leading one of the other bits together with the bits after it, and the rarest
offer stays - leading-zero count and mantissa in 16 bits. Buckets that no shingle has chosen are open to the next round, with other
hashes, and what ROUNDS rounds leave empty takes the rarest offer of all shingles: registers of small sets are as independent as those of
large ones, and each agrees with the probability of the similarity. Bands of registers lead similar documents to the same
key; the share of equal registers, less the share that agrees by chance, estimates the Jaccard similarity; what may reach
the threshold is verified on full sets. Sets with few subsets large enough for a link meet by the hashes of those as well, and
are verified without an estimate.

Work is kept linear in hot groups. Equal sets are one node from the start (a hash aggregate). Then every node is compared with
the best of the smallest members of its buckets, at most one verification a node, and verified links are joined to
components. Only buckets that still hold several components are left: their nodes outside the bucket's largest component
are compared with all others of the bucket, block by block. Pairs inside a component need no look, since a component's
members and not its links are the result; between different components every candidate pair is verified.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm.frames import keyed_text, map_slices, shared_folder, written
from noticeforge.llm.words import ALNUM, LOWER_VALUES, NOT_SPACE, Slice, mix, runs, span_hashes, windows

BUCKETS, ROUNDS = 128, 16
MANTISSA = 10
#: Bands are as long as a link at the threshold is missed by all of them with at most this probability.
MISSED = 1e-7
#: The estimate from which a pair is verified lies so many standard deviations below the threshold.
DEVIATIONS = 5.1
#: Sets with at most so many subsets that reach the threshold with them offer all of these.
SUBSETS = 64
#: Expected share of registers that agree by chance, by the HyperMinHash paper (times 2**-MANTISSA and a factor of the sizes).
CHANCE = 0.169919487159739093975315012348
#: Offers that are made at once.
_OFFERS = 1 << 20
#: A node of over one in so many pairs is dealt to all tasks: there are at most so many.
HOT = 1_000
#: Nodes of a bucket that meet as many others at once, about.
BLOCK = 256
_U = np.uint64

WORD_CLASSES = {"spaced": NOT_SPACE, "alnum": ALNUM}


def shingle_sets(s: Slice, size: int, words: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and where each row's begin."""
    starts, ends, first = runs(s, WORD_CLASSES[words])
    h = span_hashes(s.buf, starts, ends, LOWER_VALUES)
    g, at = windows(h, first, size)
    row = np.searchsorted(first, at, side="right") - 1
    n_words = np.diff(first)
    for n in range(1, size):  # texts of fewer words are one shingle
        short = np.flatnonzero(n_words == n)
        if len(short):
            x = np.zeros(len(short), np.uint64)
            for k in range(n):
                x = x * _U(0x9E3779B97F4A7C15) + h[first[short] + k]
            g, row = np.concatenate([g, mix(x + _U(n))]), np.concatenate([row, short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[fresh], row[fresh]
    return g, np.searchsorted(row, np.arange(len(s) + 1))


def band_size(similarity: float) -> int:
    """Registers of a band."""
    return max((r for r in range(1, 9) if (1 - similarity**r) ** (BUCKETS // r) <= MISSED), default=1)


def _offers(h: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and register value (1 to 65535, larger is rarer) of each shingle hash."""
    h = mix(h ^ (_U(0x5851F42D4C957F2D) + salt.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    shift = int(math.log2(BUCKETS))
    rest = h & _U((1 << (64 - shift)) - 1)
    # of at most 57 bits, frexp's exponent of the upper bits is exact enough only below 53 bits: two steps
    high = (rest >> _U(26)).astype(np.int64)
    low = (rest & _U((1 << 26) - 1)).astype(np.int64)
    length = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 26, np.frexp(low.astype(np.float64))[1])
    zeros = (64 - shift) - length
    up = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    down = np.maximum(MANTISSA - (length - 1), 0).astype(np.uint64)
    mantissa = ((rest >> up) << down) & _U((1 << MANTISSA) - 1)
    value = (zeros.astype(np.uint64) << _U(MANTISSA)) + (_U((1 << MANTISSA) - 1) - mantissa) + _U(1)
    return (h >> _U(64 - shift)).astype(np.int64), np.minimum(value, _U(65535)).astype(np.uint16)


def registers(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of BUCKETS registers for each set; all 0 for an empty one."""
    n, sizes = len(at) - 1, np.diff(at)
    out = np.zeros(n * BUCKETS, np.uint16)
    row = np.repeat(np.arange(n), sizes)
    for k in range(ROUNDS):
        gaps = (out.reshape(n, BUCKETS) == 0).any(axis=1)
        if k:
            some = gaps[row]
            g_, row_ = g[some], row[some]
        else:
            g_, row_ = g, row
        if not len(g_):
            break
        bucket, value = _offers(g_, np.array([k]))
        place = row_ * BUCKETS + bucket
        free = out[place] == 0
        np.maximum.at(out, place[free], value[free])
    rows, buckets = np.nonzero((out.reshape(n, BUCKETS) == 0) & (sizes > 0)[:, None])
    done = np.cumsum(sizes[rows])
    while len(rows):  # what is left, a bounded number of offers at a time
        m = max(1, int(np.searchsorted(done, _OFFERS + (done[0] - sizes[rows[0]]), side="right")))
        r, b = rows[:m], buckets[:m]
        first = np.concatenate([[0], np.cumsum(sizes[r])[:-1]])
        which = np.repeat(at[r] - first, sizes[r]) + np.arange(int(sizes[r].sum()))
        value = _offers(g[which], ROUNDS + np.repeat(b, sizes[r]))[1]
        out[r * BUCKETS + b] = np.maximum.reduceat(value, first)
        rows, buckets, done = rows[m:], buckets[m:], done[m:]
    return out.reshape(n, BUCKETS)


def subset_keys(g: np.ndarray, at: np.ndarray, similarity: float) -> list[list[int] | None]:
    """Hashes of all subsets of each set that have a similarity of at least `similarity` with it, its own among them; None if there are over SUBSETS."""
    n = np.diff(at)
    value = mix(g ^ _U(0x69696969))
    out: list[list[int] | None] = [None] * len(n)
    for size in np.unique(n[n > 0]).tolist():
        most = math.floor((1 - similarity) * size + 1e-9)
        if sum(math.comb(size, k) for k in range(most + 1)) > SUBSETS:
            break
        rows = np.flatnonzero(n == size)
        v = value[at[rows][:, None] + np.arange(size)]
        whole = v.sum(axis=1, dtype=np.uint64)
        keys = [mix(whole - v[:, list(c)].sum(axis=1, dtype=np.uint64) + _U(size - k)) for k in range(most + 1) for c in itertools.combinations(range(size), k)]
        for i, x in zip(rows, np.stack(keys, axis=1).view(np.int64).tolist()):
            out[i] = x
    return out


def set_sums(g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes of each set."""
    return [np.diff(np.concatenate([[_U(0)], np.cumsum(mix(g ^ _U(salt)))])[at]).view(np.int64) for salt in (0xA5A5A5A5, 0x3C3C3C3C)]


def sketches(docs: DataFrame, size: int, words: str, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """id, t (a hash of the text), n (set size), node (a hash of the set), registers and subset keys of every row."""
    df = keyed_text(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("t"))

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        g, at = shingle_sets(s, size, words)
        columns = [batch.column(0), batch.column(2), pa.array(np.diff(at)), *map(pa.array, set_sums(g, at)), pa.array([r.tobytes() for r in registers(g, at)], pa.binary()), pa.array(subset_keys(g, at, similarity), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "t", "n", "k1", "k2", "regs", "subsets"])

    made = map_slices(df, rows, f"id {dict(df.dtypes)['id']}, t long, n long, k1 long, k2 long, regs binary, subsets array<long>")
    return made.select("id", "t", "n", F.xxhash64("k1", "k2", "n").alias("node"), "regs", "subsets")


def _matrix(column: pa.Array) -> np.ndarray:
    """A row of registers for each value of a binary column without nulls."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(c.buffers()[2], np.uint16)[c.offset * BUCKETS : (c.offset + len(c)) * BUCKETS] for c in chunks if len(c)]
    return np.concatenate([np.zeros(0, np.uint16), *parts]).reshape(-1, BUCKETS)


def _bands(size: int):
    """A step that gives the key of each band of `size` registers of each node, with the node and its id."""

    def step(batches):
        for batch in batches:
            regs = _matrix(batch.column(2)).astype(np.uint64)
            many = BUCKETS // size
            bands = regs[:, : many * size].reshape(len(regs), many, size)
            key = np.broadcast_to(np.arange(1, many + 1, dtype=np.uint64), bands.shape[:2]).copy()
            for k in range(size):
                key = mix(key * _U(65536) ^ bands[:, :, k])
            owner = pa.array(np.repeat(np.arange(len(regs)), many))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(owner), batch.column(1).take(owner)], ["key", "node", "id"])

    return step


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of register rows of sets of sizes n and m, corrected for registers that agree by chance."""
    equal = (a == b).mean(axis=1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = CHANCE * 4 * ratio / (1 + ratio) ** 2 * 2.0**-MANTISSA
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def common(items: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted sets `one` with the sets `two`, as a product of 0/1 matrices over what both sides hold."""
    out = np.zeros((len(one), len(two)), np.int64)
    if not len(one) or not len(two):
        return out
    sides = [(np.concatenate([items[k] for k in part]), np.repeat(np.arange(len(part)), [len(items[k]) for k in part])) for part in (one, two)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for values, row in sides:
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        places.append((at[hit], row[hit]))
    for k in range(0, len(shared), 4096):
        m = []
        for (at, row), n in zip(places, out.shape):
            part = (at >= k) & (at < k + 4096)
            x = np.zeros((n, min(4096, len(shared) - k)), np.float32)
            x[row[part], at[part] - k] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of some true cells of a matrix that connect the rows and columns which its true cells do; fewer cells than rows and columns."""
    edges, seen = [], [np.zeros(n, bool) for n in linked.shape]
    for start in np.flatnonzero(linked.any(axis=1)):
        if seen[0][start]:
            continue
        seen[0][start] = True
        front, side = np.array([start]), 0
        while len(front):
            cells = linked[front] if side == 0 else linked[:, front].T
            new = np.flatnonzero(cells.any(axis=0) & ~seen[1 - side])
            by = front[np.argmax(cells[:, new], axis=0)]
            edges.append((by, new) if side == 0 else (new, by))
            seen[1 - side][new] = True
            front, side = new, 1 - side
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(e[0] for e in edges)]), np.concatenate([none, *(e[1] for e in edges)])


def _by_group(fn, keys: int):
    """A step over batches whose rows come sorted by the first `keys` columns: fn of each whole group, as a table."""

    def step(batches):
        left: pa.Table | None = None

        def cut(x: pa.Table, last: bool):
            columns = [x.column(k).to_numpy() for k in range(keys)]
            new = np.ones(x.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            at = np.append(np.flatnonzero(new), x.num_rows)
            whole = len(at) - 1 if last else len(at) - 2
            made = [y for k in range(whole) if (y := fn(x.slice(at[k], at[k + 1] - at[k]).combine_chunks())) is not None]
            rest = None if last else x.slice(at[whole]).combine_chunks()
            return (pa.concat_tables(made).to_batches() if made else []), rest

        for batch in batches:
            if batch.num_rows:
                x = pa.Table.from_batches([batch])
                out, left = cut(pa.concat_tables([left, x]) if left is not None else x, False)
                yield from out
        if left is not None and left.num_rows:
            yield from cut(left, True)[0]

    return step


class _Work:
    """One run's tables in the shared folder."""

    def __init__(self, spark: SparkSession, similarity: float):
        self.spark, self.folder, self.count = spark, shared_folder(spark), 0
        #: The similarity as written, as a fraction.
        self.part, self.whole = Fraction(str(similarity)).limit_denominator(10**6).as_integer_ratio()
        self.least = similarity - DEVIATIONS * math.sqrt(similarity * (1 - similarity) / BUCKETS)
        #: Sets of fewer shingles offer all their subsets and are verified whatever the estimate says.
        self.small = next(n for n in itertools.count(1) if sum(math.comb(n, k) for k in range(math.floor((1 - similarity) * n + 1e-9) + 1)) > SUBSETS)
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return written(df, self.folder, f"t{self.count}")

    def joined(self, pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        """The written table pairs (a, b) with the columns of its nodes in a and b. A b that over one in HOT pairs name, of which there are at most HOT, goes to
        all tasks and its pairs are dealt to them."""
        least = pairs.count() / HOT
        hot = [r[0] for r in pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(least, HOT)).select("b").collect()]
        both = pairs.join(a, "a")
        if not hot:
            return both.join(b, "b")
        is_hot = F.col("b").isin(hot)
        dealt = both.withColumn("_deal", F.when(is_hot, F.pmod(F.xxhash64("a"), F.lit(self.tasks)).cast("int")).otherwise(0))
        every = b.withColumn("_deal", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(self.tasks - 1))).otherwise(F.array(F.lit(0)))))
        return dealt.join(every, ["b", "_deal"]).drop("_deal")

    def estimated(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """The pairs of the written table (a, b), b the id of a first row, as pairs of nodes with an estimate, those that are small or may reach the threshold."""
        side = lambda c, by: reps.select(by.alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"), F.col("node").alias(f"node_{c}"))

        def rows(batches):
            for x in batches:
                if not x.num_rows:
                    continue
                n, m = np.asarray(x.column(2)), np.asarray(x.column(4))
                e = estimate(_matrix(x.column(3)), _matrix(x.column(5)), n, m)
                near = ((e >= self_least) | (np.minimum(n, m) < self_small)) & (np.minimum(n, m) * whole >= part * np.maximum(n, m))
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(e)], ["a", "b", "e"]).filter(pa.array(near))

        self_least, self_small, part, whole = self.least, self.small, self.part, self.whole
        both = self.joined(pairs, side("a", F.col("node")), side("b", F.col("first.id"))).where(F.col("node_a") != F.col("node_b"))
        joined = both.select("node_a", "node_b", "n_a", "regs_a", "n_b", "regs_b")
        return joined.mapInArrow(rows, "a long, b long, e double")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The written table's pairs (a, b) whose full sets reach the threshold."""
        side = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"items_{c}"))
        both = F.size(F.array_intersect("items_a", "items_b"))
        sizes = F.size("items_a") + F.size("items_b")
        return self.joined(pairs, side("a"), side("b")).where(self.whole * both.cast("long") >= self.part * (sizes - both).cast("long")).select("a", "b")

    def sets(self, docs: DataFrame, leaders: DataFrame, size: int, words: str, id_col: str, text_col: str) -> DataFrame:
        """The written table node and items, the sets of the rows that the leaders (id, t) name, each node once."""

        def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
            g, at = shingle_sets(s, size, words)
            items = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(g.view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.diff(at)), *map(pa.array, set_sums(g, at)), items], ["n", "k1", "k2", "items"])

        texts = keyed_text(docs, id_col, text_col).withColumn("t", F.xxhash64("text")).join(leaders, ["id", "t"], "left_semi").select("text")
        found = self.written(map_slices(texts, rows, "n long, k1 long, k2 long, items array<long>").select(F.xxhash64("k1", "k2", "n").alias("node"), "items"))
        if found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
            return found
        return self.written(found.groupBy("node").agg(F.first("items").alias("items")))  # rows that stand several times

    def told(self, rows: DataFrame, firsts: DataFrame) -> DataFrame:
        """The rows (id, t, n, node) with first_id and first_t of their node. Those of nodes that hold over one in HOT rows, at most HOT of them, and of none aren't shuffled."""
        least = rows.count() / HOT
        hot = [r[0] for r in firsts.where(F.col("copies") > max(least, HOT)).select("node").collect()]
        is_hot, names = F.col("node").isin(hot), ["id", "t", "n", "first_id", "first_t"]
        some, firsts = rows.where(F.col("n") > 0), firsts.drop("copies")
        kind = firsts.schema["first_id"].dataType
        out = rows.where(F.col("n") == 0).select("id", "t", "n", F.lit(None).cast(kind).alias("first_id"), F.lit(None).cast("long").alias("first_t"))
        out = out.unionByName(some.where(~is_hot).join(firsts, "node", "left").select(*names))
        return out.unionByName(some.where(is_hot).join(F.broadcast(firsts.where(is_hot)), "node", "left").select(*names)) if hot else out

    def links_in_blocks(self, open_: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) between different components that share a bucket of open_: enough to connect whatever such links connect.

        The nodes outside a bucket's largest component, in blocks of about BLOCK, meet all its nodes, in such blocks as well: one
        pair of blocks is what a task holds at once. First the sizes and registers tell which nodes of two blocks may have a link at
        all, then those bring their full sets. All pairs are compared; of the links found, a task gives no more than connect its nodes.
        """
        number = lambda count, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        keep = ["key", "node", "comp", "size", "regs"]
        outer = open_.where(F.col("comp") != F.col("main")).withColumn("ob", number("out_blocks", 1)).withColumn("ab", every("all_blocks")).withColumn("side", F.lit(0))
        all_ = open_.withColumn("ab", number("all_blocks", 2)).withColumn("ob", every("out_blocks")).withColumn("side", F.lit(1))
        least, small, part, whole = self.least, self.small, self.part, self.whole

        def near(x: pa.Table) -> pa.Table | None:
            side = np.asarray(x.column("side"))
            regs, n, comp = _matrix(x.column("regs")), np.asarray(x.column("size")), x.column("comp").to_numpy()
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            used = np.zeros(len(side), bool)
            for k in range(0, len(one), 32):  # 32 rows of registers against all: a few MB at once
                i = one[k : k + 32]
                a, b = np.repeat(i, len(two)), np.tile(two, len(i))
                e = estimate(regs[a], regs[b], n[a], n[b])
                hit = ((e >= least) | (np.minimum(n[a], n[b]) < small)) & (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) * whole >= part * np.maximum(n[a], n[b]))
                used[a[hit]] = used[b[hit]] = True
            return x.filter(pa.array(used)).select(["key", "ob", "ab", "side", "node", "comp"]) if used.any() else None

        def linked(x: pa.Table) -> pa.Table | None:
            side, comp, node = np.asarray(x.column("side")), x.column("comp").to_numpy(), x.column("node")
            items = [np.asarray(v.values) for v in x.column("items")]
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            both = common(items, one, two)
            n = np.array([len(v) for v in items])
            union = n[one][:, None] + n[two][None, :] - both
            i, j = spanning((whole * both >= part * union) & (comp[one][:, None] != comp[two][None, :]))
            return pa.table({"a": node.take(pa.array(one[i])), "b": node.take(pa.array(two[j]))}) if len(i) else None

        n = self.tasks
        place = ["key", "ob", "ab"]
        meet = outer.select(*place, "side", *keep[1:]).unionByName(all_.select(*place, "side", *keep[1:])).repartition(n, *place).sortWithinPartitions(*place)
        may = self.written(meet.mapInArrow(_by_group(near, 3), "key long, ob int, ab int, side int, node long, comp long"))
        full = may.join(sets, "node").select(*place, "side", "node", "comp", "items").repartition(n, *place).sortWithinPartitions(*place)
        return full.mapInArrow(_by_group(linked, 3), "a long, b long").distinct()

    def components(self, edges: DataFrame) -> DataFrame:
        """node and comp, the smallest node that it reaches, for all nodes of the edges: every node moves to its smallest neighbour,
        along two more such steps, and the graph of what is left is worked on again."""
        e = self.written(edges)
        labels = None
        while True:
            both = e.select("a", "b").union(e.select("b", "a")).toDF("node", "other")
            up = self.written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("up")))
            for _ in range(2):
                above = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
                up = up.join(above, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
            up = self.written(up)
            if labels is None:
                labels = up.select("node", F.col("up").alias("comp"))
            else:
                step = up.select(F.col("node").alias("comp"), "up")
                labels = labels.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
            labels = self.written(labels)
            a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in ("a", "b"))
            moved = e.join(a, "a").join(b, "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
            e = self.written(moved.where(F.col("a") != F.col("b")).distinct())
            if e.isEmpty():
                return labels


def _grouped(docs: DataFrame, similarity: float, size: int, words: str, id_col: str, text_col: str) -> DataFrame:
    """id, t (a hash of the text), n, and of the first row (by id and t) of each one's component its id and t; these are null for empty sets and, where no row of a component has an id, for all of it."""
    work = _Work(docs.sparkSession, similarity)
    sigs = work.written(sketches(docs, size, words, id_col, text_col, similarity))
    # equal sets are one node, whatever their ids; a node is known by the hash of its set and led by its first row
    first = F.min(F.struct("id", "t")).alias("first")
    reps = work.written(sigs.where(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("regs").alias("regs"), F.first("subsets").alias("subsets")))

    # sets of up to 1 / (1 - similarity) - 1 shingles can only link with equal ones
    least = math.floor(1 / (1 - similarity) + 1e-9) - 1 if similarity < 1 else 0
    large = reps.where(F.col("n") >= least)
    kind = dict(sigs.dtypes)["id"]
    bands = large.select("node", "first.id", "regs").mapInArrow(_bands(band_size(similarity)), f"key long, node long, id {kind}").unionByName(large.select(F.explode("subsets").alias("key"), "node", "first.id"))
    # all nodes of a bucket meet the one of the smallest id, from which copies are likely made
    shared = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.min("node").alias("low"), F.max("node").alias("top")).where(F.col("low") != F.col("top")).select("key", "pivot")
    buckets = work.written(bands.join(shared, "key").select("key", "node", "pivot"))

    star = work.written(work.estimated(work.written(buckets.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()), reps))
    sets = work.sets(docs, reps.join(buckets.select("node").distinct(), "node", "left_semi").select("first.id", "first.t"), size, words, id_col, text_col)

    best = work.written(star.groupBy("a").agg(F.max_by("b", F.struct("e", -F.xxhash64("b"))).alias("b")))
    edges = work.written(work.verified(best, sets))
    labels = work.components(edges)

    # what is left: in buckets with several components, all nodes beside the largest one against the others
    held = buckets.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("comps")).where(F.col("comps") > 1)
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    largest = largest.select("key", F.col("top.comp").alias("main"), blocks(F.col("c")).alias("all_blocks"), blocks(F.col("c") - F.col("top.c")).alias("out_blocks"))
    open_ = work.written(held.join(largest, "key").join(reps.select("node", F.col("n").alias("size"), "regs"), "node"))
    labels = work.components(edges.unionByName(work.links_in_blocks(open_, sets)))

    of_node = reps.select("node", "first", "copies").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = of_node.groupBy("comp").agg(F.min("first").alias("first"))
    firsts = work.written(of_node.drop("first").join(of_comp, "comp").select("node", "copies", F.col("first.id").alias("first_id"), F.col("first.t").alias("first_t")))
    return work.told(sigs.select("id", "t", "n", "node"), firsts)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, words: str = "alnum", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id that it reaches), kept (it is that one).

    Words are runs of letters, digits and characters outside ASCII ("alnum") or of all but ASCII white space ("spaced"), with
    A-Z lower-cased; a text of fewer words than a shingle is one shingle of all its words. Null texts and texts
    without words have an empty set and stand alone. A null id gets a null component and is kept, as nothing can name it.
    Rows with the same id are told apart by their texts: unlike ones are in components of their own. An empty table
    gives no rows; other columns are ignored. Links are documents whose sets have a Jaccard similarity of at least
    `similarity`. Sets with up to SUBSETS subsets that reach the threshold (of up to 10 shingles at 0.8) lose no link; of the others a link at
    the threshold is missed by the bands with a probability of at most MISSED, and by the estimate, at DEVIATIONS standard deviations, with one of about 1e-6.
    """
    found = _grouped(docs, similarity, size, words, id_col, text_col)
    component = F.when(F.col("id").isNotNull(), F.coalesce("first_id", "id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, similarity: float = 0.8, size: int = 5, words: str = "alnum", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each component: that with the smallest id, and of texts under that id the one with the smallest hash.

    A row that stands several times stays once. Rows with a null id stay, as do texts without words, which are alike to nothing. Otherwise as near_duplicates().
    """
    found = _grouped(docs, similarity, size, words, id_col, text_col)
    found = written(found.where(F.col("id").isNotNull() & (F.col("n") > 0)), shared_folder(docs.sparkSession), "told")
    is_first = (F.col("id") == F.col("first_id")) & (F.col("t") == F.col("first_t"))
    key = [x + "_" * max(map(len, docs.columns)) for x in ("id", "t")]  # longer than the names of docs
    names = [F.col(c).alias(name) for c, name in zip(("id", "t"), key)]
    gone = found.where(~is_first).select(*names).distinct()
    again = found.where(is_first).groupBy("id", "t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*names)
    same = (docs[id_col] == F.col(key[0])) & (F.xxhash64(docs[text_col].cast("string")) == F.col(key[1]))
    left = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, same).dropDuplicates(key).select(*(docs[c] for c in docs.columns))
    return left.join(again, same, "left_anti").unionByName(once)
