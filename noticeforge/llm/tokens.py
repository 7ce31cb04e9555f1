"""Token ids of whole texts by a public tokenizer file of the `tokenizers` library, with a store of known pre-tokens.

A BPE model encodes each pre-token by itself and a corpus repeats its pre-tokens, so a task cuts texts into pre-tokens
with numpy, encodes only those it hasn't seen with the library and gathers ids for the rest. That holds for the word
BPE file here (lower case, white space dropped) and for texts of ASCII and Latin-1 letters; any other text, one
that holds a special token's string, and any other tokenizer file go through the library as a whole. Tests hold both
ways equal.
"""

from __future__ import annotations

import os

import numpy as np

from noticeforge.llm import stores
from noticeforge.llm.words import VALUES, Slice, span_hashes

#: Most pre-tokens that a Python worker keeps; the store then starts anew.
STORE_SIZE = 500_000
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 20
#: Pre-tokens that the library encodes in one call.
AT_ONCE = 512

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: What the pre-tokenizer of the word BPE file splits off after an apostrophe.
_CLITICS_1, _CLITICS_2 = b"stmd", (b"re", b"ve", b"ll")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the numpy way is taken only for a file that splits as it does
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        folds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.by_words = (parts[0].get("pattern") or {}).get("Regex") == _WORD_PATTERN and folds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("dropout") is None
        self.special = [x["content"].encode() for x in spec.get("added_tokens") or []]
        self.clear()

    def clear(self) -> None:
        """An empty store: sorted hashes of pre-tokens, and where each one's ids begin in `flat` and how many there are."""
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids: list[np.ndarray] = []
        for k in range(0, len(words), AT_ONCE):  # the library's answers are large objects
            ids += [np.array(x.ids, np.uint32) for x in self.library.encode_batch(words[k : k + AT_ONCE], add_special_tokens=False)]
        size = np.array([len(x) for x in ids], np.int64)
        start = len(self.flat) + np.cumsum(size) - size
        to = np.searchsorted(self.known, hashes)
        self.known, self.start, self.size = (np.insert(old, to, new) for old, new in ((self.known, hashes), (self.start, start), (self.size, size)))
        self.flat = np.concatenate([self.flat, *ids])

    def ids(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all rows of a slice one after another, and where each row's begin (len + 1)."""
        slow = np.ones(len(s), bool)
        if self.by_words:
            slow = self._foreign(s)
            if not slow.any():
                return self._fast(s)
        rows = []
        if not slow.all():
            flat, at = self._fast(s)
            rows = [flat[at[i] : at[i + 1]] for i in range(len(s))]
        else:
            rows = [None] * len(s)
        which = np.flatnonzero(slow)
        for i, x in zip(which, self.library.encode_batch([s.text(i) for i in which], add_special_tokens=False)):
            rows[i] = np.array(x.ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)

    def _foreign(self, s: Slice) -> np.ndarray:
        """Rows that only the library can split: characters beyond ASCII and Latin-1 letters, or special tokens."""
        buf = s.buf
        wrong = buf >= 0xC0
        wrong &= buf != 0xC3
        after = np.zeros(len(buf), np.uint8)
        after[1:] = buf[:-1]
        wrong |= (after == 0xC3) & ((buf == 0x97) | (buf == 0xB7))
        at = np.flatnonzero(wrong)
        out = np.zeros(len(s), bool)
        out[np.searchsorted(s.offsets, at, side="right") - 1] = True
        data = buf.tobytes()
        for x in self.special:
            k = data.find(x)
            while k >= 0:
                out[np.searchsorted(s.offsets, k, side="right") - 1] = True
                k = data.find(x, k + 1)
        return out

    def _fast(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        buf = _LOWER[s.buf]
        n = len(buf)
        before = np.zeros(n, np.uint8)
        before[1:] = buf[:-1]
        buf[(before == 0xC3) & (buf >= 0x80) & (buf <= 0x9E)] += 0x20
        kind = _CLASS[buf]
        last = np.zeros(n, np.uint8)
        last[1:] = kind[:-1]
        cut = np.zeros(n + 1, bool)  # a token or a space run begins
        cut[:n] = (kind != last) | (kind == _DIGIT)
        cut[s.offsets] = True
        for p in np.flatnonzero((buf == 39) & cut[:n]):
            row_end = s.offsets[np.searchsorted(s.offsets, p, side="right")]
            tail = buf[p + 1 : min(p + 3, row_end)].tobytes()
            k = 1 if tail[:1] and tail[:1] in _CLITICS_1 else 2 if tail in _CLITICS_2 else 0
            if k:
                cut[p + 1 : p + 1 + k] = False
                cut[p + 1 + k] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.concatenate([starts[1:], [n]]).astype(np.int64) if len(starts) else starts
        real = kind[starts] != _SPACE
        starts, ends = starts[real], ends[real]
        h = span_hashes(buf, starts, ends, VALUES)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > STORE_SIZE:
            self.clear()
        place = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[place] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            data = buf.tobytes()
            self._learn(unique[new], [data[starts[k] : ends[k]].decode("utf-8", "replace") for k in first[new]])
            place = np.searchsorted(self.known, unique)
        word = place[back]
        sizes = self.size[word]
        to = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = self.flat[np.repeat(self.start[word] - to[:-1], sizes) + np.arange(to[-1])]
        return flat, to[np.searchsorted(starts, s.offsets)]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; its store lasts from task to task, until another stage begins."""
    return stores.kept(("encoder", path), lambda: Encoder(path))
