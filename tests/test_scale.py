"""Operators that don't meet all pairs or hold a whole key, against their plain forms."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_operators import NOW, POSITION, position

from noticeforge import bindings
from noticeforge.operators import dictionary, evaluation, extract, identity, pairing, runs, scoring, vectors
from noticeforge.schemas import SCHEMAS


def random_prefs(rng, n):
    some = lambda values, most: None if rng.random() < 0.1 else rng.sample(values, rng.randint(0, most))
    return [(k, some(["R", "S", "T"], 2), rng.choice([None, 2, 3, 5]), some(["M", "N", "L"], 2), some(["dev", "Data", "op", "lawyer"], 3), some(["T", "U", "V"], 2), some(["O", "P"], 1), some(["bad", "ops"], 1), NOW) for k in range(n)]


def random_positions(rng, n):
    pick = lambda *x: rng.choice([*x, None])
    return [
        position(f"p{k}", rng.choice([None, -5, 30, 100, 200, 900]), name=pick("Dev ops", "data lawyer", "bad dev", "clerk", "developer"), region=pick("R", "S", "X"), education=pick(1, 3, 4), major=pick("M", "N", "Unrestricted", "unrestricted", "Z"), category=pick("O", "P", "Q"), requirements=pick("T x", "dev U", "y", "data"))
        for k in range(n)
    ]


@pytest.mark.parametrize("min_score", [5.0, 35.0, 60.0, 90.0, 100.0])
def test_matches_equal_the_cross_join(spark, min_score):
    rng = random.Random(min_score)
    positions, prefs = spark.createDataFrame(random_positions(rng, 120), POSITION), spark.createDataFrame(random_prefs(rng, 90), SCHEMAS["user_preferences"])
    key = lambda df: sorted((r.position_id, r.pref_id, r.score, tuple(r.matched_rules), len(r.components)) for r in df.collect())
    want = key(scoring.score_positions(positions, prefs, F.lit(NOW)).where(F.col("passed") & (F.col("score") >= min_score)))
    assert key(pairing.score_matches(positions, prefs, F.lit(NOW), min_score)) == want and len(want) > 5
    with pytest.raises(ValueError):
        pairing.score_matches(positions, prefs, F.lit(NOW), 0.0)


def test_many_preferences_without_a_cartesian_product(spark):
    """100000 preferences of 5000 regions and keywords each: pairs come from equi joins, and rows grow with what is shared."""
    of = lambda tag, c, n: F.array(F.concat(F.lit(tag), (c % n).cast("string")))
    k, empty = F.col("id"), F.array().cast("array<string>")
    prefs = spark.range(100_000).select(k.alias("pref_id"), of("R", k, 5000).alias("regions"), F.lit(5).alias("education"), of("M", k, 7).alias("majors"), of("word", k, 4999).alias("job_keywords"), empty.alias("requirement_terms"), of("O", k, 5).alias("organization_types"), empty.alias("exclusions"), F.lit(NOW).alias("updated_at"))
    rows = [position(f"p{j}", region=f"R{j}", name=f"a word{j * 13} here", major=f"M{j % 7}", category=f"O{j % 5}") for j in range(300)]
    positions = spark.createDataFrame(rows, POSITION)
    found = pairing.score_matches(positions, prefs, F.lit(NOW), 60.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    candidates = pairing.candidate_pairs(positions, prefs, 60.0).count()
    assert candidates < 60_000  # of 30 million pairs; short words stand in longer ones
    scored = found.select("pref_id", "position_id", "score").collect()
    assert scored and all(r.score >= 60 for r in scored)


def test_pairs_share_all_that_the_score_needs(spark):
    """A pair that hits one rule of those that a score takes together is not made, nor one with a position that is over; equal wants are scored once."""
    wants = (["R"], 5, ["M"], ["T"], ["O"], [])
    positions = spark.createDataFrame([position("one", 100, name="clerk", region="R", major="Z", category="P"), position("two", 100, name="a DEV", region="R", major="Z", category="O"), position("over", -5, name="a dev", region="R", major="M", category="O")], POSITION)
    prefs = lambda keywords: spark.createDataFrame([(k, *wants[:3], keywords, *wants[3:], NOW) for k in range(50)], SCHEMAS["user_preferences"])
    assert {r.position_id for r in pairing.candidate_pairs(positions, prefs(["dev"]), 70.0).collect()} == {"two", "over"}
    found = lambda df: sorted((r.pref_id, r.position_id, r.score) for r in df.collect())
    for keywords, n in ((["dev"], 50), (["dev", ""], 100)):  # an empty keyword stands in every name
        matched = pairing.score_matches(positions, prefs(keywords), F.lit(NOW), 70.0)
        everything = scoring.score_positions(positions, prefs(keywords), F.lit(NOW))
        assert matched.columns == everything.columns
        assert found(matched) == found(everything.where("passed AND score >= 70")) and len(found(matched)) == n


def test_found_pairs_are_not_shuffled(spark, folder, monkeypatch):
    """Positions are read once, also for preferences that reach the score with anything, and what is found gets its preferences where it is; beyond the bounds the rows are the same."""
    rng = random.Random(8)
    spark.createDataFrame(random_positions(rng, 120), POSITION).write.parquet(folder + "/p")
    wants = random_prefs(rng, 60)
    prefs = spark.createDataFrame([*wants, *((100 + r[0], *r[1:]) for r in wants), wants[0]], SCHEMAS["user_preferences"])
    positions, found = spark.read.parquet(folder + "/p"), lambda df: sorted((r.position_id, r.pref_id, r.score) for r in df.collect())
    want = found(scoring.score_positions(positions, prefs, F.lit(NOW)).where("passed AND score >= 60"))
    assert pairing.indexed_prefs(prefs, 60.0).where("open").count() > 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched = pairing.score_matches(positions, prefs, F.lit(NOW), 60.0)
        plan = matched.select("pref_id", "position_id", "score")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan parquet [position_id") == 1 and "SortMergeJoin [_id" not in plan
    assert found(matched) == want and len(want) > 50
    monkeypatch.setattr(pairing, "HELD_BYTES", 0)
    monkeypatch.setattr(pairing, "BROADCAST_PREFS", 3)
    assert found(pairing.score_matches(positions, prefs, F.lit(NOW), 60.0)) == want


def test_open_positions_are_visible_and_not_over(spark, folder):
    """Null and repeated keys, orphans, posts without lines, deadlines before the start or unknown."""
    day = lambda n: None if n is None else datetime(1998, 6, 15) + timedelta(days=n)
    tables = {
        "region": ([(0, "ASIA"), (1, None)], "r_regionkey int, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 1), (2, "C", None)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "one", 0, "BUILDING"), (1, "twin", 1, None), (2, None, 1, "FURNITURE"), (3, "nowhere", 2, "BUILDING"), (None, "none", 0, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": ([(k, c, day(d)) for k, c, d in ((1, 1, -9), (2, 2, -9), (2, 2, -3), (3, 1, 5), (4, 1, None), (5, 3, -9), (6, None, -9), (7, 2, 0), (None, 1, -9))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "part": ([(1, "red gear", "STANDARD", 3, "Brand#1"), (1, "anvil", None, None, "Brand#2"), (2, None, "PROMO", 9, None), (None, "x", "y", 1, "z")], "p_partkey long, p_name string, p_type string, p_size int, p_brand string"),
        "lineitem": ([(k, p, 1, n, None if n == 3 else 2.0, 9.99, day(d)) for k in (1, 2, 2, 3, 4, 5, 6, 9, None) for p in (1, 2, 8, None) for n, d in enumerate((-20, -9, -4, 0, 1, 30, None))], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    key = lambda df: sorted(repr(sorted(r.asDict().items())) for r in df.collect())
    visible = bindings.visible(spark, folder).where(F.col("position_id").isNotNull())
    want = visible.where(~scoring.over(F.col("start_at"), F.col("deadline"), bindings.at(bindings.AS_OF)))
    found = bindings.open_positions(spark, folder)
    assert key(found) == key(want) and 50 < want.count() < visible.count() and set(found.columns) == set(visible.columns)


@pytest.mark.parametrize("block_bytes", [dictionary.BLOCK_BYTES, 200])
def test_names_equal_containment(spark, block_bytes):
    """Names within names, one after another, repeated with other ids; in one block and in many."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab省é") for _ in range(n))
    names = [(k, word(rng.randint(1, 6))) for k in range(150)] + [(7000, None), (7001, ""), (-1, "ab"), (99, "ab")]
    texts = [(k, word(rng.randint(0, 40))) for k in range(200)] + [(900, None), (901, "")]
    df, known = spark.createDataFrame(texts, "document_id long, text string").repartition(3), spark.createDataFrame(names, "id long, name string")
    found = dictionary.with_names(df, F.col("text"), known, "x", block_bytes)
    least = {}
    for i, n in names:
        if n:
            least[n] = min(i, least.get(n, i))
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert sorted((x.name, x.id) for x in r.x) == sorted((n, i) for n, i in least.items() if n in (r.text or ""))
    regions = known.select(F.col("id").cast("int").alias("region_id"), "name")
    best = {r.document_id: r.region for r in extract.match_regions(df, regions).collect()}
    for k, t in texts:
        inside = [(-len(n), i, n) for n, i in least.items() if n in (t or "")]
        assert (best[k] is None and not inside) or (len(best[k]), least[best[k]]) == (-min(inside)[0], min(inside)[1])


def test_slots_equal_the_plain_join(spark):
    rng = random.Random(6)
    base = datetime(2026, 3, 28, 20)
    moments = [base + timedelta(minutes=rng.randrange(0, 4000, 10)) for _ in range(300)]
    for kind in ("timestamp", "timestamp_ntz"):
        slots = spark.createDataFrame([(rng.randrange(3), t) for t in moments[:120]] + [(None, base), (1, None)], f"source_id long, slot_at {kind}")
        log = spark.createDataFrame([(k, rng.randrange(3), t, "success") for k, t in enumerate(moments[120:])] + [(999, None, base, "failed"), (998, 1, None, "failed")], f"run_id long, source_id long, finished_at {kind}, status string")
        for interval in ("6 HOURS", "10 MINUTES", "1 MONTH"):
            r = log.withColumnRenamed("source_id", "s")
            inside = (F.col("source_id") == F.col("s")) & (F.col("finished_at") >= F.col("slot_at")) & (F.col("finished_at") < F.col("slot_at") + F.expr(f"INTERVAL {interval}"))
            want = sorted(map(str, slots.join(r, inside, "left").select("source_id", "slot_at", "run_id", "finished_at", "status").collect()))
            got = runs.slots_in_window(slots, log, interval)
            assert got.columns == ["source_id", "slot_at", "run_id", "finished_at", "status"] and sorted(map(str, got.collect())) == want


def test_slots_of_one_source_are_linear(spark):
    """10^5 slots and as many runs of one source."""
    at = F.timestamp_seconds(F.col("id") * 60)
    slots = spark.range(100_000).select(F.lit(1).cast("long").alias("source_id"), at.alias("slot_at"))
    log = spark.range(100_000).select(F.col("id").alias("run_id"), F.lit(1).cast("long").alias("source_id"), (at + F.expr("INTERVAL 30 SECONDS")).alias("finished_at"), F.lit("success").alias("status"))
    began = time.time()
    assert runs.slots_in_window(slots, log, "5 MINUTES").count() == 5 * 100_000 - 10
    assert time.time() - began < 60


def random_runs(rng, n):
    """Runs of a few sources over some days, bursts within an hour, equal starts, missing times and ends."""
    rows = []
    for k in range(n):
        start = NOW + timedelta(hours=rng.choice([0, 0, 0, 1, 5, 30, 31, 90]), minutes=rng.randrange(60))
        rows.append((k, rng.choice([1, 1, 1, 2, None]), rng.choice([start] * 9 + [None]), rng.choice([None, start + timedelta(minutes=rng.randrange(1, 4000, 37))]), rng.choice(["success", "failed", "failed", None])))
    return rows


def test_streaks_by_hours_equal_whole_sources(spark):
    rows = random_runs(random.Random(8), 400)
    log = spark.createDataFrame(rows, "run_id long, source_id long, started_at timestamp, finished_at timestamp, status string")
    got = {r.source_id: (r.longest_failures, r.current_failures) for r in runs.streaks(log, F.coalesce(F.col("status") == "success", F.lit(False))).collect()}
    for source in (1, 2, None):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[2] is not None, r[2] or NOW, r[0]))
        most = now = 0
        for r in own:
            now = 0 if r[4] == "success" else now + 1
            most = max(most, now)
        assert got[source] == (most, now)


def test_overlaps_by_hours_equal_whole_sources(spark):
    rows = random_runs(random.Random(9), 400)
    log = spark.createDataFrame(rows, "run_id long, source_id long, started_at timestamp, finished_at timestamp, status string")
    w = Window.partitionBy("source_id").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    want = log.withColumn("busy_until", F.max("finished_at").over(w)).where(F.col("busy_until") >= F.col("started_at"))
    assert sorted(map(str, runs.overlapping_runs(log).collect())) == sorted(map(str, want.collect())) != []


def test_versions_by_chunks_equal_whole_keys(spark):
    rng = random.Random(10)
    rows = [(k, rng.choice(["a", "a", "b", None]), NOW + timedelta(hours=rng.randrange(200)), rng.choice(["x", "x", "y", None])) for k in range(500)]
    docs = spark.createDataFrame(rows, "id long, page string, fetched_at timestamp, content_hash string")
    order = [F.asc("fetched_at"), F.asc("id")]
    want = identity.version_history(docs, ["page"], order)
    for chunk in (F.date_trunc("day", "fetched_at"), F.lit(1), F.col("fetched_at")):
        got = identity.version_history(docs, ["page"], order, chunk=chunk)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("part_rows", [vectors.PART_ROWS, 50])
def test_probed_vectors_reach_their_recall(spark, part_rows):
    """The given vectors, in whole cells and in cells cut into many parts."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = evaluation.vector_topk(queries, table, 10).cache()
    cells = vectors.fit_cells(table, 10)
    found = vectors.probed_topk(queries, table, 10, cells, part_rows=part_rows, query_rows=part_rows).cache()
    row = vectors.recall_of(found, exact).first()
    assert row.n == 1000 and row.recall >= 0.9 and cells.probes < len(cells.centres)
    known = {(r.query_id, r.vec_id): r.cosine for r in exact.collect()}
    rows = found.collect()
    assert all(known.get((r.query_id, r.vec_id), r.cosine) == r.cosine for r in rows) and all(r.query_id != r.vec_id for r in rows)
    assert sorted(r["rank"] for r in rows if r.query_id == 20) == list(range(1, 11))


def test_all_cells_are_the_exact_way(spark):
    """Probing every cell gives what the exact way gives; nulls, zeros and empty tables take no part."""
    rng = random.Random(14)
    rows = [(k, [float(rng.randint(-2, 2)) for _ in range(4)]) for k in range(300)] + [(900, None), (901, [0.0] * 4), (902, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    queries = df.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    cells = vectors.fit_cells(df, 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.cosine) for r in df.collect())
    got = key(vectors.probed_topk(queries, df, 5, vectors.Cells(cells.centres, len(cells.centres)), part_rows=40, query_rows=9))
    good = df.where("vec_id < 900")
    assert got == key(evaluation.vector_topk(queries.where("query_id < 900"), good, 5)) and len(got) > 100
    assert vectors.probed_topk(queries, df.limit(0), 5).count() == 0 and vectors.probed_topk(queries.limit(0), df, 5).count() == 0
