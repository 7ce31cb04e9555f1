"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Texts are cut at white space into pre-tokens; a corpus repeats them, and distinct ones share prefixes. A task takes the
distinct pre-tokens of a slice of texts that it hasn't counted yet and walks their trie depth first, that is in
sorted order with the path to the last one as a stack, of which the next one keeps the shared part. Every node of the path has the
best unigram score of any segmentation of its prefix and the number of pieces in it, computed once from the
nodes above by the pieces that end there; the node at which a pre-token ends gives its count, which the task keeps. Nothing is
shuffled, and memory is bounded by the store and one slice.

Piece scores come from a public SentencePiece model file. A file made for BPE has merge ranks for scores; as there, an earlier
piece is a likelier one, and its unigram score is minus the logarithm of its rank (Zipf's law), less a constant for each
piece. Characters that no piece covers count as their UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noticeforge.llm import stores
from noticeforge.llm.frames import keyed_text, map_slices
from noticeforge.llm.words import NOT_SPACE, Slice, runs, span_hashes

SPACE = "▁"
PER_PIECE = 2.0
#: Most pre-tokens whose counts a Python worker keeps; the store then starts anew.
STORE_SIZE = 1_000_000


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> dict[str, float]:
    """Piece -> unigram score, of all pieces that a text can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = {}
    for k in range(model.vocab_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
            out[model.id_to_piece(k)] = -float(np.log(k + 1)) - PER_PIECE
    return out


class Trie:
    """The path to the last word; words come sorted, so each shared prefix is scored once."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.least = min(scores.values(), default=0.0) - 10.0  # each byte of a character that no piece covers
        self.word, self.best, self.count = "", [0.0], [0]

    def pieces(self, word: str) -> int:
        """Number of pieces in the best segmentation of the word; of equal scores the fewer pieces."""
        shared = 0
        for x, y in zip(self.word, word):
            if x != y:
                break
            shared += 1
        del self.best[shared + 1 :], self.count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode())
            best, fewest = self.best[end - 1] + size * self.least, self.count[end - 1] + size
            for start in range(max(0, end - self.longest), end):
                score = self.scores.get(word[start:end])
                if score is not None:
                    total, n = self.best[start] + score, self.count[start] + 1
                    if total > best or total == best and n < fewest:
                        best, fewest = total, n
            self.best.append(best)
            self.count.append(fewest)
        self.word = word
        return self.count[-1]


class Counter:
    """A Python worker's terminal counts by the hash of the pre-token; at most STORE_SIZE of them."""

    def __init__(self, model_path: str):
        self.scores = vocabulary(model_path)
        self.known: dict[int, int] = {}

    def pieces(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word of a slice, and the number of each row's first word."""
        starts, ends, first = runs(s, NOT_SPACE)
        unique, at, back = np.unique(span_hashes(s.buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > STORE_SIZE:
            self.known.clear()
        hashes, data = unique.tolist(), s.buf.tobytes()
        new = sorted((SPACE + data[starts[k] : ends[k]].decode("utf-8", "replace"), x) for k, x in zip(at.tolist(), hashes) if x not in self.known)
        trie = Trie(self.scores)
        for word, x in new:
            self.known[x] = trie.pieces(word)
        return np.array([self.known[x] for x in hashes], np.int64)[back] if hashes else np.zeros(0, np.int64), first


def counter(model_path: str) -> Counter:
    return stores.kept(("counter", model_path), lambda: Counter(model_path))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words (pre-tokens), n_tokens (pieces of all of them, each led by the space mark); no shuffle.

    A null or empty text has none. Repeated rows give repeated results; a null id stays null; an empty table gives no rows;
    other columns are ignored.
    """
    df = keyed_text(docs, id_col, text_col)

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        pieces, first = counter(model_path).pieces(s)
        total = np.diff(np.concatenate([[0], np.cumsum(pieces)])[first])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(total)], ["doc_id", "n_words", "n_tokens"])

    return map_slices(df, rows, f"doc_id {dict(df.dtypes)['id']}, n_words long, n_tokens long", store=True)
