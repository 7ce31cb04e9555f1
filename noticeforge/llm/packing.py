"""Packing token sequences by minimum bin slack.

Every document is encoded and cut at multiples of the sequence length; full pieces are sequences of their own. The
rests, shorter than a sequence, wait in the task that has read them, which fills one sequence after another: the
longest piece left opens it, and a bitset subset-sum over all lengths left (as a multiset of (length, count), counts
in binary parts, longest first until the room is filled) finds the total closest to the room that remains; walking the bitsets back gives how many pieces of
each length make it. A task chooses from at most BLOCK pieces at once and keeps no more; what a block leaves
under-filled goes on to the next. So packing is one narrow pass without a shuffle. At its end a task has no better company to
wait for: it cuts pieces to fill the room that the sums leave, and the last tokens, fewer than a sequence, into
sequences of powers of two, which need no padding. So padding doesn't grow with the number of tasks.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import stores
from noticeforge.llm.frames import keyed_text
from noticeforge.llm.tokens import ENCODE_BYTES, encoder
from noticeforge.llm.words import slices

CAPACITY, END_ID = 4096, 2
#: Pieces that a task chooses from and keeps at once.
BLOCK = 4096
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
PACKED = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length make the largest total of at most `room`: subset sums as bits of an integer, walked back."""
    full, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:  # counts in binary parts: 1, 2, 4, ... of a length together
            take = min(part, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & full
            left, part = left - take, part * 2
        if sums >> room:
            break
    at, chosen = sums.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not (before >> at) & 1:
            chosen[length] += take
            at -= length * take
    return dict(chosen)


class Pool:
    """Waiting rows by length (row[2])."""

    def __init__(self, capacity: int):
        self.capacity, self.lengths, self.rows, self.size = capacity, [], {}, 0

    def add(self, row: tuple) -> None:
        if row[2] not in self.rows:
            insort(self.lengths, row[2])
            self.rows[row[2]] = []
        self.rows[row[2]].append(row)
        self.size += 1

    def take(self) -> list[tuple]:
        """The rows of the next sequence."""
        longest = self.lengths[-1]
        out = [self._pop(longest)]
        room = self.capacity - longest
        fits = {n: len(self.rows[n]) for n in self.lengths[: bisect_right(self.lengths, room)]}
        for n, c in sorted(best_fill(fits, room).items(), reverse=True):
            out += [self._pop(n) for _ in range(c)]
        return out

    def take_longest(self) -> tuple:
        return self._pop(self.lengths[-1])

    def _pop(self, length: int) -> tuple:
        rows = self.rows[length]
        row = rows.pop()
        self.size -= 1
        if not rows:
            del self.rows[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return row


def cut(row: tuple, n: int) -> tuple[tuple, tuple]:
    """The first n tokens of a waiting row and the rest."""
    key, start, length, ids, whole = row
    return (key, start, n, ids[: 4 * n], whole), (key, start + n, length - n, ids[4 * n :], whole)


def last_groups(pool: Pool) -> Iterator[list[tuple]]:
    """The rows of the last sequences of a task, which leave nothing waiting: full ones, then at most one of each power of two."""
    while pool.size:
        group = pool.take()
        room = pool.capacity - sum(row[2] for row in group)
        if room and pool.size:  # what is left is longer than the room
            first, rest = cut(pool.take_longest(), room)
            group.append(first)
            pool.add(rest)
            room = 0
        if not room:
            yield group
            continue
        left = pool.capacity - room
        while left:
            size, out = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                row = group.pop(0)
                if row[2] > size:
                    row, rest = cut(row, size)
                    group.insert(0, rest)
                out.append(row)
                size -= row[2]
            yield out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id and offset.

    Each document's ids end with end_id; a null text is an empty one, whose piece is that id alone. Each id of a document
    lies in one piece; a sequence's pieces follow each other from offset 0 without gaps. A task's last tokens make sequences of powers of two, at most
    one of each. Sequence ids are unique, not
    consecutive. Repeated rows are packed as documents of their own; a null id stays null; other columns are
    ignored; an empty table gives no rows. A task that runs again over the same rows makes the same sequences.
    """
    df = keyed_text(docs, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = itertools.count(TaskContext.get().partitionId() << 40)
        pool, id_type = Pool(capacity), None

        def placed(group: list[tuple]) -> list[tuple]:
            number, offsets = next(sequence), itertools.accumulate((row[2] for row in group), initial=0)
            return [(*row, number, offset) for row, offset in zip(group, offsets)]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], NAMES)

        def filled() -> list[tuple]:
            """Sequences of a full pool, down to a quarter of it; the under-filled wait for better company."""
            out, waiting = [], []
            while pool.size > BLOCK // 4:
                group = pool.take()
                if sum(row[2] for row in group) >= capacity - capacity // 64:
                    out += placed(group)
                else:
                    waiting += group
            if not out and waiting:  # nothing fits anything: no use in waiting
                while waiting:
                    pool.add(waiting.pop())
                while pool.size > BLOCK // 4:
                    out += placed(pool.take())
            for row in waiting:
                pool.add(row)
            return out

        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for s in slices(batch.column(1), ENCODE_BYTES):
                flat, at = encoder(tokenizer_path).ids(s)
                out: list[tuple] = []
                for i in range(len(s)):
                    own = np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(own) // 4
                    for a in range(0, n, capacity):
                        row = (keys[s.first + i], a, min(capacity, n - a), own[4 * a : 4 * (a + capacity)], n)
                        if row[2] == capacity:
                            out += placed([row])
                        else:
                            pool.add(row)
                            if pool.size >= BLOCK:
                                out += filled()
                if out:
                    yield batch_of(out)
            stores.give_back()  # a batch leaves many arrays of its size behind
        out = [row for group in last_groups(pool) for row in placed(group)]
        if out:
            yield batch_of(out)

    return df.mapInArrow(rows, PACKED.format(dict(df.dtypes)["id"]))


def crc32_of_ids(packed: DataFrame) -> DataFrame:
    """The rows of pack() with ids_crc32 (unsigned, of the little-endian ids) in place of the ids, which are never null or empty; an empty table gives no rows."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
