"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths are compared within each text with numpy; what counts is how many of its
characters lie inside n-grams or lines that occur more than once, so that overlapping repeats count once. A longer
n-gram can only repeat where both shorter ones inside it do, hence each length looks at the places left by the one before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noticeforge.llm.frames import keyed_text, map_slices
from noticeforge.llm.words import NOT_SPACE, Slice, mix, runs, span_hashes, windows

#: Per cent of a text's word characters that may lie inside repeated n-grams of a length, first occurrences included.
NGRAM_LIMITS = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
#: Per cent of a text's characters (line ends aside) that may lie in lines equal to an earlier line.
LINE_LIMIT = 20
MIN_WORDS, REPEAT_PER_CENT = 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id {}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars long, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS) + ", base_failed boolean, kept boolean"


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[first])


def _repeated(keys: np.ndarray) -> np.ndarray:
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[back] > 1


def measure(s: Slice) -> dict[str, np.ndarray]:
    starts, ends, first = runs(s, NOT_SPACE)
    lead = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80, dtype=np.int64)])
    chars = lead[ends] - lead[starts]
    out = {"n_words": np.diff(first), "word_chars": _per_row(chars, first), "n_symbols": _per_row(_SYMBOL[s.buf], s.offsets)}

    newline = np.flatnonzero(s.buf == 10)
    edge = np.unique(np.concatenate([s.offsets[:-1], newline + 1]))
    line_start = edge[edge <= len(s.buf)]
    # a line ends before its \n or with its row
    row = np.searchsorted(s.offsets, line_start, side="right") - 1
    keep = row < len(s)
    line_start, row = line_start[keep], row[keep]
    next_newline = np.concatenate([newline, [len(s.buf)]])[np.searchsorted(newline, line_start)]
    line_end = np.minimum(next_newline, s.offsets[row + 1])
    word = np.concatenate([[0], np.cumsum(NOT_SPACE[s.buf], dtype=np.int64)])
    real = word[line_end] > word[line_start]
    size = lead[line_end] - lead[line_start]
    line_start, line_end, row = line_start[real], line_end[real], row[real]
    keys = span_hashes(s.buf, line_start, line_end) ^ mix((row + 1).astype(np.uint64))
    _, head = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[head] = False
    out["n_dup_lines"] = np.bincount(row[again], minlength=len(s)).astype(np.int64)
    out["dup_line_chars"] = np.bincount(row[again], weights=(lead[line_end] - lead[line_start])[again], minlength=len(s)).astype(np.int64)
    out["chars"] = np.diff(lead[s.offsets]) - _per_row(s.buf == 10, s.offsets)

    h = span_hashes(s.buf, starts, ends)
    row_key = mix(np.repeat(np.arange(1, len(s) + 1, dtype=np.uint64), np.diff(first)))
    at = None
    for n in NGRAM_LIMITS:
        if n == min(NGRAM_LIMITS):
            key, at = windows(h, first, n)
        else:  # both shorter n-grams inside repeat
            at = at[:-1][np.diff(at) == 1] if len(at) else at
            at = at[_fits(at, first, n)]
            key = np.zeros(len(at), np.uint64)
            for k in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
            key = mix(key)
        at = at[_repeated(key ^ row_key[at])] if len(at) else at
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        inside = np.cumsum(edge)[:-1] > 0
        if n == 5:
            out["n_repeat_words"] = _per_row(inside, first)
        out[f"dup_{n}gram_chars"] = _per_row(chars * inside, first)
    return out


def _fits(at: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Windows of n words that end in the row in which they begin."""
    return at + n <= first[np.searchsorted(first, at, side="right")] if len(at) else np.zeros(0, bool)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with its measures, base_failed and kept; no shuffle.

    A null or empty text has no words, so base_failed is true and kept false. Repeated rows give repeated results; a
    null id stays null; other columns of the input are ignored. kept is false if base_failed (under MIN_WORDS
    words, or over REPEAT_PER_CENT of the words in repeated 5-word windows), or if the characters inside repeated
    n-grams of any length pass NGRAM_LIMITS, or those in repeated lines LINE_LIMIT.
    """

    def rows(batch: pa.RecordBatch, s: Slice) -> pa.RecordBatch:
        m = measure(s)
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PER_CENT * m["n_words"])
        bad = failed | (100 * m["dup_line_chars"] > LINE_LIMIT * m["chars"])
        for n, limit in NGRAM_LIMITS.items():
            bad |= 100 * m[f"dup_{n}gram_chars"] > limit * m["word_chars"]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        m |= {"base_failed": failed, "kept": ~bad}
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in names[1:])], names)

    df = keyed_text(docs, id_col, text_col)
    return map_slices(df, rows, SCHEMA.format(dict(df.dtypes)["id"]))
