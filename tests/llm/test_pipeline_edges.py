"""The pipeline and its stages on empty tables, null and repeated ids, repeated rows and columns of clashing names."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
EXTRA = ["id", "found", "key", "score", "t", "kept", "items", "spans", "text_", "y", "node", "rest"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Two folders of tables: an empty one, and one with rows that are awkward."""
    out = {}
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    item = bench.where("length(text) > 60").first().text
    one, two, mail = " ".join(f"word{k}" for k in range(40)), " ".join(f"other{k}" for k in range(40)), "Write to jane.doe@example.com or +1 (415) 555-1234 about it, please, soon"
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two), (4, None), (4, ""), (None, one), (None, None), (5, mail), (6, item), (7, "x " * 30000), (8, f"{one} more")]
    awkward = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "s", None if k % 5 else 7) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        awkward = awkward.withColumn(c, F.lit(c))
    for name, df in (("empty", docs.limit(0)), ("awkward", awkward)):
        folder = str(tmp_path_factory.mktemp("spark"))
        for t, x in (("documents", df), ("labels", labels.limit(0)), ("benchmark", bench)):
            x.write.parquet(f"{folder}/{t}.parquet")
        out[name] = folder
    return out, rows, item, one, two


def test_stages_on_awkward_rows(spark, made):
    folders, rows, item, one, two = made
    sf_dir = folders["awkward"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    every = collections.Counter(rows)
    kept = corpus_pipeline.reject_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns and counted(kept) == every  # without labels nothing is rejected
    unique = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    want = collections.Counter({x: n for x, n in every.items() if x not in ((2, one), (3, two), (8, f"{one} more"))})
    assert unique.columns == docs.columns and counted(unique) == want and want[2, two] == 1
    clean = corpus_pipeline.drop_contaminated(spark, unique, sf_dir)
    del want[6, item]
    assert clean.columns == docs.columns and counted(clean) == want
    private = corpus_pipeline.pseudonymise(spark, clean, sf_dir)
    assert private.columns == docs.columns and private.count() == sum(want.values())
    texts = {r.doc_id: r for r in private.collect()}
    assert "jane.doe" not in texts[5].text and "555-1234" not in texts[5].text and texts[7].text == "x " * 30000 and texts[5].n_chars == len(texts[5].text)
    assert all(r[c] == c for r in private.collect() for c in EXTRA)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.start == 0) == collections.Counter(i for (i, _), n in want.items() for _ in range(n))


def test_an_empty_table(spark, made):
    docs = spark.read.parquet(f"{made[0]['empty']}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, made[0]["empty"]).count() == 0
    assert corpus_pipeline.run(spark, made[0]["empty"]).count() == 0
