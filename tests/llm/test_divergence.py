"""Source divergence against brute force over all terms and pairs, and its index against plain counts."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from noticeforge.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def expected(rows, min_docs=30, ranks=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs, groups = collections.Counter(), collections.Counter(), sorted({r[1:] for r in rows})
    for text, lang, source in rows:
        found = TERM.findall(text.translate(LOWER))
        counts.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = set()
    for lang, source in groups:
        own = [s for x, s in groups if x == lang]
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        total = {s: sum(counts[lang, s, t] for t in kept) for s in own}
        share = lambda n, whole: 1 + 10**9 * (n + 5) // (whole + 5 * len(kept))  # noqa: E731, B023
        pairs = [(-sum(abs(share(counts[lang, source, t], total[source]) - share(counts[lang, s, t], total[s])) for t in kept), s.encode(), s) for s in own if s != source]
        terms = []
        for t in kept:
            f = share(counts[lang, source, t], total[source]) - share(sum(counts[lang, s, t] for s in own), sum(total.values()))
            if counts[lang, source, t] and f > 0:
                terms.append((-f, t.encode(), t))
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out |= {(lang, source, part, item, -minus, k) for k, (minus, _, item) in enumerate(items, 1)}
    return out


def found(df, **options):
    rows = [tuple(r) for r in divergence.source_divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def invented(seed=5, n=400):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "éclair", "ÉCLAIR", "naïve", "你好", "x", "zz", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for _ in range(n):
        source = f"s{min(rng.randrange(9), rng.randrange(9))}"
        some = rng.sample(words, 12) if source != "s3" else words[:3]
        rows.append((" ".join(rng.choices(some, k=rng.randrange(30))) + " a1b@c_d-e", rng.choice(["en", "en", "fr"]), source))
    return rows + [("rare words of a language", "de", "s1"), ("", "de", "s2"), ("alpha beta", "it", "only")]


def test_divergence_by_brute_force(spark):
    rows = invented()
    want = expected(rows)
    assert {r[2] for r in want} == {"pair", "term"} and ("de", "s1", "pair", "s2", 0, 1) in want
    assert found(spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)) == want


@pytest.mark.parametrize("limit", ["runs", "blocks", "shards"])
def test_small_bounds_change_nothing(spark, monkeypatch, limit):
    """Many runs a task, sources in blocks that take a pass a pair, and many shards."""
    rows = invented(7, 300)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    options = {"blocks": {"block": 4}, "shards": {"shard_terms": 20}}.get(limit, {})
    assert found(df, **options) == expected(rows)
    block = divergence.Block()
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "CHUNK", 3)
    made = []
    for k in range(0, len(rows), 10):
        part = rows[k : k + 10]
        (s,) = divergence.slices(pa.array([r[0] for r in part]))
        block.add(s, [r[1:] for r in part])
        if block.full:
            made.append(block.run())
            assert not block.parts and not block.terms
    if block.parts:
        made.append(block.run())
    assert len(made) > 3 and all(len(p["sizes"]) <= 7 for own in made for p in own)
    for own in made:
        for lang in {p["lang"] for p in own}:
            pieces = [p["terms"] for p in own if p["lang"] == lang]
            keys = divergence.terms_of(pa.array(pieces), [lang] * len(pieces))[3]
            assert all(p.endswith(" ") for p in pieces)
            assert (np.diff(keys.astype(object)) > 0).all()
    batches = [divergence._pieces(own, {"run": [k] * len(own), "place": list(range(len(own)))}) for k, own in enumerate(made)]
    dealt = pa.Table.from_batches(list(divergence._dealt(3)(iter(batches))))
    dealt = dealt.take(pa.array(np.random.default_rng(0).permutation(dealt.num_rows)))
    shards = [divergence.merged_runs(dealt.filter(pa.array(dealt.column("shard").to_numpy() == k)), 2) for k in range(8)]
    assert sum(t.num_rows > 0 for t in shards) > 4
    merged = pa.concat_tables(shards).to_pylist()
    found_in = lambda r: TERM.findall(r[0].translate(LOWER))
    docs = collections.Counter((r[1], t) for r in rows for t in set(found_in(r)))
    want = collections.Counter((r[1], r[2], t) for r in rows for t in found_in(r) if docs[r[1], t] >= 2)
    assert {(m["lang"], x["source"], m["term"]): x["n"] for m in merged for x in m["postings"] if m["term"]} == want
    assert {(m["lang"], m["term"]): m["n_docs"] for m in merged if m["term"]} == {k: n for k, n in docs.items() if n >= 2}
    assert {(m["lang"], x["source"]) for m in merged for x in m["postings"] if not m["term"]} == {r[1:] for r in rows}


def test_divergence_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == expected([(r.text, r.lang, r.source) for r in docs.collect()])


def test_divergence_of_awkward_rows(spark):
    rows = [(None, None, None), ("", "en", None), ("a b " * 40, None, "x"), ("a " * 30000 + "É" * 20000, "en", "y"), *[("a b", "en", "z")] * 31, *[("b c", None, None)] * 30, *[("a", "en", "é")] * 2]
    df = spark.createDataFrame([(*r, "i", "p", 1) for r in rows], "text string, lang string, source string, item string, part string, value long")
    assert found(df) == expected(rows)
    assert found(df.limit(0)) == set()


def test_shares_do_not_overflow():
    n, below = [0, 5, 10**12, 7 * 10**14, 10**15], [7, 5, 10**13, 8 * 10**14, 10**15 + 1]
    assert divergence.shares(np.array(n), np.array(below)).tolist() == [1 + 10**9 * a // b for a, b in zip(n, below)]
