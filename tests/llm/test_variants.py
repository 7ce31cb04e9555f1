"""Spelling variants against brute force: counts from Python's regular expressions and crc32, near words from deletions and replacements."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from noticeforge.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words_of(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def near(a, b):
    """By the plain definition of one edit."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows):
    n = {w: c for w, c in words_of(rows).items() if len(w) >= 6 and c >= 5}
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    forms, n_near = {}, {}
    for w in n:
        close = [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if near(w, x)]
        n_near[w] = len(close)
        best = min(close, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n[w], n_near[w], n[forms[w]] if forms[w] else None))
    return out


def found(df, **options):
    rows = [tuple(r) for r in variants.spelling_variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def misspelled(seed=3, distinct=40):
    """Texts of words, their one-edit neighbours and neighbours of those, in chains of falling counts; ÷, × and ÿ are letters here, ß and œ too or not."""
    rng = random.Random(seed)
    alphabet = "abcdefghijéß÷×ÿ"
    bag = []
    for _ in range(distinct):
        word, n = "".join(rng.choice(alphabet) for _ in range(rng.choice([6, 7, 8, 12, 60]))), 700
        while n >= 5:
            bag += [rng.choice([word, word.upper() if word.isascii() else word])] * n
            k, n = rng.randrange(len(word)), n // rng.choice([2, 5, 6])
            word = rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice(alphabet) + word[k:], word[:k] + rng.choice(alphabet) + word[k + 1 :]])
    rng.shuffle(bag)
    return [(k, " ".join(bag[k::50]).replace("j", "jœ") if k % 7 == 0 else " ".join(bag[k::50])) for k in range(50)]


@pytest.mark.parametrize("tile", [variants.TILE, 2])
def test_variants_by_brute_force(spark, tile):
    """With a tile of two words nearly all buckets are split to the end; the result is the same."""
    rows = misspelled()
    want = expected(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile) == want


def test_one_hot_bucket(spark):
    """Words that share all but one place, and all their beginning, meet in buckets of any size."""
    letters = [chr(k) for k in [*range(97, 123), *range(0xDF, 0x100)]]
    some = [f"prefix{a}{b}" for a in letters[:30] for b in letters]
    rows = [(k, " ".join(some)) for k in range(5)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), tile=64) == expected(rows)


def test_variants_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_variants_of_awkward_rows(spark):
    """Nulls, blanks, repeated rows and ids, a very long word, clashing names."""
    long = "x" * 30000 + "y"
    rows = [(None, "Letter letter LETTER lettre"), (None, None), (1, ""), (2, "letter letters"), (2, "letter letters"), (3, f"{long} {long[1:]} " * 6), (4, "ététait 7letter7 letters letters letters lettœr")]
    df = spark.createDataFrame([(*r, "w", 1, "f") for r in rows], "doc_id long, text string, word string, n long, form string")
    assert found(df) == expected(rows)
    assert found(df.limit(0)) == set()


def test_checksums_of_spans():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 4000, 300))
    ends = starts + rng.integers(0, 120, 300)
    before = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    assert [zlib.crc32(buf[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before)] == variants.checksums(buf, starts, ends, before).tolist()
