import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeforge.llm import packing, tokens, words

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "it's don't we'll 'sword ,'s a'b ''s x'RE y'Ve", "É À Ñ ß × ÷ ÿ", "你好 é 123 4a5", "<|endoftext|> hi", "a b\x85c", "__a_b --'t", "İstanbul ΑΣ", "\x00\x1c\x1f a\x0bb", "'", "'s", "x '", "a'", "'r", "'ll", "'lla", "é", "K", "a" * 3000]
CASES = st.lists(st.one_of(st.text(max_size=40), st.sampled_from(ODD), st.none()), max_size=8)


def texts_of(rows):
    return [t or "" for t in rows]


def clean(rows):
    return [t if t is None else t.encode("utf-8", "ignore").decode() for t in rows]


@settings(max_examples=60, deadline=None)
@given(CASES, st.integers(1, 200))
def test_words_equal_regex(rows, most):
    rows = clean(rows)
    for pattern, table in ((rb"[^\x20\x09-\x0D]+", words.NOT_SPACE), (rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", words.ALNUM)):
        got = []
        for s in words.slices(pa.array(rows, pa.string()), most):
            starts, ends, first = words.runs(s, table)
            got += [[s.buf[starts[k] : ends[k]].tobytes() for k in range(first[i], first[i + 1])] for i in range(len(s))]
        assert got == [re.findall(pattern, t.encode()) for t in texts_of(rows)]


def test_hashes_depend_on_the_word_alone():
    col = pa.array(["the cat THE", "cat the", None, "x" * 5000 + " the"])
    one = {}
    for most in (4, 1 << 20):
        for s in words.slices(col, most):
            starts, ends, _ = words.runs(s, words.ALNUM)
            for a, b, h in zip(starts, ends, words.span_hashes(s.buf, starts, ends, words.LOWER_VALUES)):
                word = s.buf[a:b].tobytes().lower()
                assert one.setdefault(word, h) == h
    assert len(set(one.values())) == len(one) == 3


def test_windows_stay_in_their_row():
    h = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    found, at = words.windows(h, np.array([0, 3, 3, 7]), 3)
    assert at.tolist() == [0, 3, 4] and found[0] == found[1] != found[2]


@settings(max_examples=60, deadline=None)
@given(CASES)
def test_fast_encoding_equals_the_library(rows):
    rows = clean(rows)
    enc = tokens.encoder(P.path("word_bpe_49k.json"))
    for s in words.slices(pa.array(rows, pa.string()), 100):
        flat, at = enc.ids(s)
        for i in range(len(s)):
            assert flat[at[i] : at[i + 1]].tolist() == enc.library.encode(s.text(i), add_special_tokens=False).ids


def test_other_files_go_through_the_library():
    enc = tokens.encoder(P.path("byte_bpe_50k.json"))
    assert not enc.by_words
    s = next(words.slices(pa.array(["Hello it's 12"])))
    assert enc.ids(s)[0].tolist() == enc.library.encode("Hello it's 12", add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(1, 60))
def test_best_fill_is_the_best(counts, room):
    used = packing.best_fill(counts, room)
    total = sum(n * c for n, c in used.items())
    best = max(t for t in (sum(n * c for n, c in zip(counts, combo)) for combo in itertools.product(*(range(c + 1) for c in counts.values()))) if t <= room)
    assert total == best and all(c <= counts[n] for n, c in used.items())
