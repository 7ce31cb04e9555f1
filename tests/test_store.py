import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticeforge.operators import runs
from noticeforge.operators.identity import attachment_links, discover_links, drop_boilerplate, duplicate_flags, same_store
from noticeforge.plans import registry
from noticeforge.schemas import SCHEMAS
from noticeforge.sources import attachments, keys, store
from noticeforge.streaming import intake

T = [datetime(2026, 1, d) for d in range(1, 10)]


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["snapshots"])


def test_append_is_idempotent_and_keeps_versions(spark, folder):
    path = f"{folder}/versions"
    first = pages(spark, (1, "http://e.com/a?utm_source=x", "one", T[0]), (1, "http://e.com/b", "two", T[0]), (2, "http://e.com/a", "one", T[0]))
    assert store.append_versions(first, path) == 3
    before = store.versions(spark, path).cache()
    before.count()
    assert store.append_versions(first, path) == 0
    assert store.append_versions(pages(spark, (1, "http://e.com/a", " one ", T[1])), path) == 0
    assert same_store(before, store.versions(spark, path)).first() == (0, 0)
    assert store.append_versions(pages(spark, (1, "http://e.com/a", "changed", T[2])), path) == 1
    assert store.versions(spark, path).count() == 4
    current = {(r.source_id, r.canonical_url): r.raw_html for r in store.current(spark, path).collect()}
    assert current[1, "http://e.com/a"] == "changed" and len(current) == 3
    assert store.backfill(spark, path, F.lit(T[2]), F.lit(T[3]), 1).count() == 1


def test_versions_do_not_depend_on_batches(spark, folder):
    states = [(1, "http://e.com/a", x, T[k]) for k, x in enumerate(("one", "two", "two", "one", "three"))]
    stored = lambda path: sorted((r.fetched_at, r.raw_html) for r in store.versions(spark, path).collect())
    want = [(T[0], "one"), (T[1], "two"), (T[3], "one"), (T[4], "three")]
    assert store.append_versions(pages(spark, *states), f"{folder}/whole") == 4
    assert sum(store.append_versions(pages(spark, x), f"{folder}/each") for x in states) == 4
    assert stored(f"{folder}/whole") == stored(f"{folder}/each") == want
    assert store.append_versions(pages(spark, *states), f"{folder}/whole") == 0
    back = pages(spark, (1, "http://e.com/a", "four", T[5]), (1, "http://e.com/a", "three", T[6]))
    assert store.append_versions(back, f"{folder}/whole") == 2 and stored(f"{folder}/whole") == [*want, (T[5], "four"), (T[6], "three")]


def test_streaming_intake(spark, folder):
    landed, path, cursor = f"{folder}/in", f"{folder}/versions", f"{folder}/cursor"
    batch = pages(spark, (1, "http://e.com/a", "one", T[0]), (2, "http://e.com/b", "two", T[0])).coalesce(1)
    batch.write.mode("append").parquet(landed)
    assert intake.run_crawl(spark, landed, cursor, path) == 2
    assert intake.run_crawl(spark, landed, cursor, path) == 0
    batch.write.mode("append").parquet(landed)  # the same rows in another file
    assert intake.run_crawl(spark, landed, cursor, path) == 0
    pages(spark, (1, "http://e.com/a", "new", T[1]), (2, "http://e.com/b", "new", T[1])).write.mode("append").parquet(landed)
    assert intake.run_crawl(spark, landed, cursor, path, source_id=2) == 1
    assert store.snapshots(spark, landed).count() == 6


def test_links_of_three_layouts(spark):
    rows = [
        (1, "https://e.com/list/", '<ul><li><a href="/d/1">x</a><a href="2.html">y</a></ul>'),
        (2, "https://e.com/list/i.html", '<table><td><a class="t" href="//f.com/x.pdf?utm_source=a">p</a>'),
        (3, "https://e.com/", "<p>no links"),
    ]
    links = discover_links(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"])
    assert sorted((r.page_id, r.link) for r in links.collect()) == [(1, "https://e.com/d/1"), (1, "https://e.com/list/2.html"), (2, "https://f.com/x.pdf")]
    assert attachment_links(links).count() == 1


def test_duplicates_by_url_or_hash(spark):
    rows = [(1, 1, "a", "h1"), (2, 1, "a", "h2"), (3, 1, "b", "h1"), (4, 2, "a", "h1"), (5, 1, None, None), (6, 1, None, None)]
    found = duplicate_flags(spark.createDataFrame(rows, "id long, source_id long, canonical_url string, content_hash string"), [F.asc("id")])
    assert {r.id for r in found.where("duplicate").collect()} == {2, 3}


def test_boilerplate_goes(spark):
    docs = spark.createDataFrame([(1, 1, "menu\nalpha"), (2, 1, "menu\nbeta"), (3, 2, "menu\ngamma"), (4, 1, None)], "document_id long, source_id long, raw_text string")
    assert {r.document_id: r.clean_text for r in drop_boilerplate(docs, 2).collect()} == {1: "alpha", 2: "beta", 3: "menu\ngamma", 4: ""}


def test_attachments(spark, folder):
    pdf = b"%PDF-1.7 text %%EOF"
    rows = [
        ("a.pdf", len(pdf), len(pdf), "application/pdf", pdf),
        ("b.pdf", 5, 5, "application/pdf", b"<html><body>404"),
        ("c.pdf", 8, 100, "application/pdf", b"%PDF-1.7"),
        ("d.xlsx", 4, 4, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", b"PK\x03\x04"),
        ("e.xls", 4, None, "application/pdf", b"\xd0\xcf\x11\xe0"),
        ("f.pdf", 99 << 20, None, "application/pdf", pdf),
        ("g.pdf", 0, None, "application/pdf", None),
    ]
    files = spark.createDataFrame(rows, "path string, length long, declared_length long, mime_type string, content binary")
    found = {r.path[0]: (r.status, r.reason) for r in attachments.validate_attachment(files).collect()}
    assert found == {"a": ("ok", None), "b": ("rejected", "html_error_page"), "c": ("incomplete", "incomplete"), "d": ("ok", None), "e": ("rejected", "mime_mismatch"), "f": ("rejected", "too_large"), "g": ("rejected", "empty")}
    assert [r.complete for r in attachments.check_length(files).orderBy("path").collect()] == [True, True, False, True, True, True, False]
    assert {r.path[0]: r.parser for r in attachments.route(files, {"application/pdf": "p"}).collect()}["d"] == "unsupported"
    raw = spark.createDataFrame([(1, pdf), (2, b"%PDF /Encrypt %%EOF"), (3, b"%PDF cut"), (4, b"PK"), (5, None)], "id long, content binary")
    assert {r.id: r.parse_status for r in attachments.pdf_status(raw).collect()} == {1: "ok", 2: "encrypted", 3: "corrupt", 4: "corrupt", 5: "corrupt"}
    named = spark.createDataFrame([(p, n, n, "application/pdf", pdf) for p, n in (("x/a.PDF", 19), ("b.exe", 19), ("c", 19), ("d.pdf?v=1", 19))], "path string, length long, declared_length long, mime_type string, content binary")
    assert [r.reason for r in attachments.validate_attachment(named).collect()] == [None, "wrong_extension", "wrong_extension", None]
    pages_ = spark.createDataFrame([(1, 1, "x" * 80 + "\n\nsecond"), (2, 1, " "), (2, 2, None)], "attachment_id long, page int, text string")
    assert {r.attachment_id: r.parse_status for r in attachments.flag_scans(pages_).collect()} == {1: "ok", 2: "ocr_required"}
    assert [(r.block_no, r.text) for r in attachments.to_blocks(pages_).where("attachment_id = 1").collect()][1] == (1, "second")
    import pathlib

    pathlib.Path(folder, "one.pdf").write_bytes(pdf)
    pathlib.Path(folder, "two.pdf").write_bytes(pdf)
    scanned = attachments.scan_attachments(spark, folder)
    assert scanned.select("sha256").distinct().count() == 1 and scanned.count() == 2
    assert attachments.scan_attachments(spark, folder, max_size=3).count() == 0


def test_new_attachments(spark):
    batch = spark.createDataFrame([("s1", "u1", "d1"), ("s1", "u2", "d1"), ("s2", "u3", "d2")], "sha256 string, url string, document_id string")
    known = spark.createDataFrame([("s2",)], "sha256 string")
    docs = spark.createDataFrame([("d1", "c1"), ("d2", "c2")], "document_id string, canonical_url string")
    assert [tuple(r) for r in attachments.new_attachments(batch, known, docs).collect()] == [("d1", "s1", "u1", "c1")]


def test_registry_and_sources(spark):
    registry.register("adapter", "html_list", lambda df: df)
    with pytest.raises(ValueError):
        registry.register("adapter", "html_list", lambda df: df)
    with pytest.raises(KeyError):
        registry.resolve("adapter", "nope")
    sources = spark.createDataFrame([(1, "html_list"), (2, "nope")], "source_id long, adapter string")
    with pytest.raises(ValueError, match="nope"):
        runs.resolve_adapters(sources, registry.registered("adapter"))
    assert runs.resolve_adapters(sources.where("source_id = 1"), registry.registered("adapter")).count() == 1
    states = spark.createDataFrame([(1, True, T[0]), (1, False, T[2]), (2, True, T[1])], SCHEMAS["source_events"])
    assert {r.source_id: r.enabled for r in runs.source_states(states).collect()} == {1: False, 2: True}


def test_outbox(spark, folder):
    reports = spark.createDataFrame([(1,), (2,)], "report_id long")
    sent = spark.createDataFrame([(1, "email", "success", T[0]), (2, "email", "failed", T[0]), (2, "email", "failed", T[1]), (2, "wechat", "failed", T[0]), (2, "wechat", "failed", T[1]), (2, "wechat", "failed", T[2])], "report_id long, channel string, status string, sent_at timestamp")
    listed = {(r.report_id, r.channel): (r.attempts, r.state, r.next_attempt) for r in runs.delivery_list(reports, sent, ["email", "wechat"], 3).collect()}
    assert listed == {(1, "wechat"): (0, "new", None), (2, "email"): (2, "retry", datetime(2026, 1, 2, 0, 2)), (2, "wechat"): (3, "permanent", None)}
    store.outbox(reports, sent, ["email"], f"{folder}/outbox")
    assert spark.read.parquet(f"{folder}/outbox").count() == 1
    assert store.outbox(reports, sent, ["email"], f"{folder}/outbox").count() == 1
    assert spark.read.parquet(f"{folder}/outbox").count() == 1


def test_one_source_after_another(spark, folder):
    landed, cursor, path = f"{folder}/landed1", f"{folder}/cursor1", f"{folder}/store1"
    pages(spark, (1, "http://e.com/a", "one", T[0]), (2, "http://f.com/a", "two", T[0])).write.parquet(landed)
    assert intake.run_crawl(spark, landed, cursor, path, source_id=2) == 1
    assert intake.run_crawl(spark, landed, cursor, path) == 1
    assert intake.run_crawl(spark, landed, cursor, path, source_id=2) == 0
    assert sorted(r.source_id for r in store.versions(spark, path).collect()) == [1, 2]


def test_deliveries_again_after_a_newer_version(spark, folder):
    path = f"{folder}/again"
    one, two = (pages(spark, (1, "http://e.com/a", body, at)) for body, at in (("v1", T[0]), ("v2", T[1])))
    assert [store.append_versions(x, path) for x in (one, two, one, one, two)] == [1, 1, 0, 0, 0]
    assert store.append_versions(pages(spark, (1, "http://e.com/b", "x", T[0]), (1, "http://e.com/b", "y", T[1]), (1, "http://e.com/b", "x", T[2])), path) == 3


def test_pages_without_html_are_stored(spark, folder):
    path = f"{folder}/nulls"
    rows = pages(spark, (1, "http://e.com/a", None, T[0]), (1, "http://e.com/a", None, T[1]), (1, "http://e.com/a", "x", T[2]), (1, "http://e.com/a", None, T[3]))
    assert store.append_versions(rows, path) == 3 and store.append_versions(rows, path) == 0
    assert store.append_versions(pages(spark, (1, "http://e.com/a", None, T[4])), path) == 0
    assert [r.fetched_at for r in store.versions(spark, path).orderBy("fetched_at").collect()] == [T[0], T[2], T[3]]


def test_random_crawls_equal_one_pass(spark, folder):
    """Batches of any size and order, late snapshots among them, against a plain reading of all snapshots in order."""
    rng = random.Random(12)
    rows = [(rng.randrange(2), f"http://e.com/{rng.randrange(4)}", rng.choice(["one", "two", None]), T[0] + timedelta(hours=k)) for k in range(60)]
    path, at = f"{folder}/random", 0
    while at < len(rows):
        n = rng.randrange(5, 20)
        store.append_versions(pages(spark, *rows[at : at + n]).repartition(3), path)
        at += n
    want, last = [], {}
    for source, url, body, t in rows:
        if last.get((source, url), "none yet") != body:
            want.append((source, url, body, t))
            last[source, url] = body
    stored = lambda: [(r.source_id, r.canonical_url, r.raw_html, r.fetched_at) for r in store.versions(spark, path).collect()]
    assert sorted(stored(), key=str) == sorted(want, key=str)
    late = rng.sample(rows, 20)
    store.append_versions(pages(spark, *late), path)
    assert sorted(stored(), key=str) == sorted(want, key=str)


def test_a_second_crawl_reads_no_texts(spark, folder):
    """The plan reads the key table of the batch's sources, behind its filter; the versions only where a snapshot is late."""
    path = f"{folder}/plans"
    store.append_versions(pages(spark, *((k % 3, f"http://e.com/{k}", "x" * 100, T[0]) for k in range(300))), path)
    table = keys.table(spark, path, store.versions(spark, path))
    batch = pages(spark, (1, "http://e.com/1", "new", T[1]), (1, "http://e.com/999", "new", T[1]))
    rows = store.keyed(batch)
    probable = keys.probable(keys.read(spark, table).where("source_id = 1"), rows)
    assert [r.canonical_url for r in probable.collect()] == ["http://e.com/1"]
    plan = probable._jdf.queryExecution().executedPlan().toString()
    assert "raw_html" not in plan and "PartitionFilters: [isnotnull(source_id" in plan and "BroadcastHashJoin" in plan
    assert store.append_versions(batch, path) == 2
    assert keys.latest(keys.read(spark, table)).count() == 301


def test_the_filter_keeps_all_keys(spark):
    pages_ = spark.range(5000).select((F.col("id") % 7).alias("source_id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("canonical_url"))
    asked = pages_.where("canonical_url like '%3'")
    for bits in (1 << 10, 1 << 17, keys.FILTER_BITS):
        found = {r.canonical_url for r in keys.probable(pages_, asked, bits).collect()}
        assert {r.canonical_url for r in asked.collect()} <= found
    assert len(found) < 510


def test_many_files_become_few(spark, folder, monkeypatch):
    path = f"{folder}/files"
    for k in range(4):
        store.append_versions(pages(spark, (1, "http://e.com/a", f"v{k}", T[k]), (1, f"http://e.com/{k}", "x", T[k])), path)
    monkeypatch.setattr(keys, "MOST_FILES", 3)
    before = store.versions(spark, path).count()
    assert store.append_versions(pages(spark, (1, "http://e.com/a", "v3", T[5])), path) == 0 and store.versions(spark, path).count() == before
    table = keys.table(spark, path, store.versions(spark, path))
    assert keys.read(spark, table).count() == 5 and keys._generations(spark, path)[0] > 1


@pytest.mark.parametrize("step", ["versions", "states", "note"])
def test_a_killed_batch_run_again(spark, folder, monkeypatch, step):
    """Dead after the versions, after the states or after the note of the batch: the same batch again leaves the same store."""
    path, cursor = f"{folder}/killed-{step}", "c"
    first = pages(spark, (1, "http://e.com/a", "one", T[0]), (2, "http://e.com/b", "two", T[0]))
    second = pages(spark, (1, "http://e.com/a", "three", T[1]), (2, "http://e.com/b", "two", T[1]))
    assert intake.apply_batch(first, 0, path, cursor) == 2

    def die(*a):
        raise RuntimeError("killed")

    place = {"versions": "append", "states": "note_batch", "note": "mark"}[step]
    kept = getattr(keys, place)
    monkeypatch.setattr(keys, place, die if step != "note" else lambda s, p, on: kept(s, p, on) if on else die())
    with pytest.raises(RuntimeError):
        intake.apply_batch(second, 1, path, cursor)
    monkeypatch.setattr(keys, place, kept)
    intake.apply_batch(second, 1, path, cursor)
    assert sorted((r.source_id, r.raw_html) for r in store.versions(spark, path).collect()) == [(1, "one"), (1, "three"), (2, "two")]
    assert intake.apply_batch(pages(spark, (1, "http://e.com/a", "three", T[2])), 2, path, cursor) == 0
    assert keys.last_batch(spark, path, cursor) == 2 and not keys.exists(spark, f"{keys.beside(path)}/_appending")


def test_bounded_batches_of_a_partitioned_folder(spark, folder):
    """Two files a batch; of a folder in parts by source, only the part of the source is read."""
    landed, cursor, path = f"{folder}/parts", f"{folder}/parts-cursor", f"{folder}/parts-store"
    for k in range(5):
        pages(spark, (1, f"http://e.com/{k}", "one", T[k]), (2, f"http://f.com/{k}", "two", T[k])).coalesce(1).write.mode("append").partitionBy("source_id").parquet(landed)
    sizes = []
    intake.intake(spark, landed, f"{folder}/look", lambda batch, k: sizes.append((k, batch.count(), len(batch.inputFiles()))), 2, files_per_batch=2)
    assert [n for _, n, _ in sizes] == [2, 2, 1]
    assert intake.run_crawl(spark, landed, cursor, path, source_id=2, files_per_batch=2) == 5
    assert intake.run_crawl(spark, landed, cursor, path, source_id=2) == 0
    assert intake.run_crawl(spark, landed, cursor, path, files_per_batch=3) == 5
    assert {r.source_id for r in store.versions(spark, path).collect()} == {1, 2}
