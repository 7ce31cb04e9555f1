"""Token-id files with a shared zstandard dictionary.

A dictionary is trained once on the serialized id arrays of a bounded sample of documents. Each document's ids
(little-endian uint32) are compressed by themselves with it, so any one can be read alone. Documents are dealt to range
partitions by ascending id and written as shards: rows of a Parquet table, each with the dictionary's hash, an index (for each
document its id, number of ids, and end of its bytes) and the compressed documents one after another. Parquet
is only the container: it goes to any file system that Spark writes to, its first_id and last_id columns let a reader
skip to a document's shard, and the index gives the bytes to decompress. The dictionary lies beside the shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeforge.llm.frames import keyed_text, map_slices
from noticeforge.llm.tokens import ENCODE_BYTES, encoder
from noticeforge.llm.words import Slice, slices

END_ID = 2
#: The sample for the dictionary: documents, of each at most so many bytes of ids, and the dictionary's size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 64 << 10, 64 << 10
#: Bytes of compressed documents after which a shard ends.
SHARD_BYTES = 256 << 10
SHARD = "part int, shard long, first_id long, last_id long, n_docs long, n_ids long, ids_before long, dictionary string, doc_index binary, payload binary"


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and ids (little-endian uint32, ended with end_id) of every row."""

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        flat, at = encoder(tokenizer_path).ids(s)
        ids = [np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4").tobytes() for i in range(len(s))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    named = keyed_text(docs, id_col, text_col).select(F.col("id").try_cast("long").alias("id"), "text")
    return map_slices(named, rows, "doc_id long, ids binary", store=True)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A dictionary from the SAMPLE_DOCS rows with the smallest hash of id; without enough data to train on, no bytes."""
    import zstandard

    picked = docs.select(docs[id_col].alias("id")).where(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).distinct()
    sample = keyed_text(docs, id_col, text_col).join(F.broadcast(picked), "id")
    ids = encoded(sample, tokenizer_path, end_id, "id", "text").select("doc_id", F.substring("ids", 1, SAMPLE_BYTES).alias("ids"))
    samples = [bytes(r.ids) for r in sorted(ids.distinct().limit(SAMPLE_DOCS).collect(), key=lambda r: (r.doc_id, bytes(r.ids)))]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> None:
    """Write the shards of all rows to path/shards and the dictionary to path/dictionary.

    A null text is an empty one and has the end id alone. The index holds ids as 64-bit integers; what isn't one counts as null. Rows with a null id come before all others; repeated rows are
    written each, next to each other. An empty table gives a table without shards.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_col, text_col)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "dictionary string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        data = shared.value
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data)) if data else zstandard.ZstdCompressor(level=level)
        name = hashlib.sha256(data).hexdigest()
        keys: list = []
        sizes: list[int] = []
        blobs: list[bytes] = []
        held = done = 0

        def shard() -> pa.RecordBatch:
            ends = np.cumsum([len(b) for b in blobs])
            known = np.array([k is not None for k in keys])
            index = np.stack([np.array([k or 0 for k in keys], np.int64), known.astype(np.int64), np.array(sizes, np.int64), ends.astype(np.int64)], 1)
            values = [part, number, keys[0], keys[-1], len(keys), sum(sizes), done, name, index.astype("<i8").tobytes(), b"".join(blobs)]
            kinds = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for s in slices(batch.column(1), ENCODE_BYTES):
                flat, at = encoder(tokenizer_path).ids(s)
                for i in range(len(s)):
                    keys.append(names[s.first + i])
                    sizes.append(int(at[i + 1] - at[i]) + 1)
                    blobs.append(press.compress(np.append(flat[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()))
                    held += len(blobs[-1])
                    if held >= SHARD_BYTES:
                        yield shard()
                        number, done = number + 1, done + sum(sizes)
                        keys, sizes, blobs, held = [], [], [], 0
        if keys:
            yield shard()

    # texts, not ids, go through the shuffle, so that finding the ranges encodes nothing
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed_text(docs, id_col, text_col)
    dealt = keyed.select(F.col("id").try_cast("long").alias("id"), "text").repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    dealt.mapInArrow(shards, SHARD).write.parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["bytes"])
    if hashlib.sha256(data).hexdigest() != row["dictionary"]:
        raise ValueError(f"the dictionary of {path} doesn't have its hash")
    return row["dictionary"], data


def read(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the shards, or of one by its index entry."""
    name, data = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast((name, data))
    table = spark.read.schema(SHARD).parquet(f"{path}/shards")
    # a shard knows the ids before it in its task; the tasks' totals are as many rows as there were partitions
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    if doc_id is not None:
        table = table.where(F.lit(doc_id).between(F.coalesce("first_id", F.lit(-(1 << 63))), F.col("last_id")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        name, data = shared.value
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)) if data else zstandard.ZstdDecompressor()
        for batch in batches:
            for first, used, index, payload in zip(*(batch.column(k) for k in range(4))):
                if used.as_py() != name:
                    raise ValueError("a shard was written with another dictionary")
                index = np.frombuffer(index.as_buffer(), "<i8").reshape(-1, 4)
                payload = memoryview(payload.as_buffer())
                start = first.as_py() + np.concatenate([[0], np.cumsum(index[:, 2])])
                begin = np.concatenate([[0], index[:-1, 3]])
                which = np.arange(len(index)) if doc_id is None else np.flatnonzero((index[:, 0] == doc_id) & (index[:, 1] == 1))
                ids = [press.decompress(payload[begin[i] : index[i, 3]]) for i in which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(index[i, 0]) if index[i, 1] else None for i in which], pa.int64()), pa.array(start[which], pa.int64()), pa.array(index[which, 2], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    joined = table.join(F.broadcast(before), "part").select((F.col("before") + F.col("ids_before")).alias("first"), "dictionary", "doc_index", "payload")
    return joined.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


