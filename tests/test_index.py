"""The state of the index, its changes, and what its columns say."""

from datetime import datetime

from pyspark.sql import functions as F

from korrel.functions import files as X
from korrel.functions import text as T
from korrel.functions import vectors as VX
from korrel.operators import enrichment, events
from korrel.operators import index as I

FILES = "id long, device_id string, path string, name string, extension string, size_bytes long, last_modified long, indexed_at long, content_snip string, ocr_pending boolean"


def rows(spark, data):
    return spark.createDataFrame(data, FILES)


A = (1, "d", "/s/Work/a.pdf", "a.pdf", "pdf", 10, 100, 1000, None, True)
A2 = (2, "d", "/s/Work/a.pdf", "a.pdf", "pdf", 20, 200, 2000, "x", False)
B = (3, "e", "/s/Work/a.pdf", "a.pdf", "pdf", 10, 0, 1000, "y", False)


def test_latest_takes_the_row_indexed_last_and_the_larger_id_of_equal_ones(spark):
    tie = (9, *A2[1:])
    assert {r.id for r in I.latest(rows(spark, [A, A2, tie, B])).collect()} == {9, 3}
    assert I.latest(rows(spark, [])).count() == 0


def test_upsert_delete_rename(spark):
    stored, new = rows(spark, [A, B]), rows(spark, [A2])
    assert {r.id for r in I.upsert(stored, new).collect()} == {2, 3}
    assert {r.id for r in I.without(stored, new).collect()} == {3}
    moves = spark.createDataFrame([("d", "/s/Work/a.pdf", "/s/Old/b.TXT")], "device_id string, path string, new_path string")
    got = {r.id: r for r in I.renamed(stored, moves).collect()}
    assert (got[1].path, got[1].name, got[1].extension) == ("/s/Old/b.TXT", "b.TXT", "txt") and got[3].path == "/s/Work/a.pdf"
    assert {r.last_modified for r in I.forced(stored).collect()} == {0}


def test_changes(spark):
    seen = rows(spark, [A2, B, (4, "d", "/new", "new", "", 1, 1, 1, None, False)])
    got = {(r.device_id, r.path): r.status for r in I.changes(rows(spark, [A, B, (5, "d", "/gone", "gone", "", 1, 1, 1, None, False)]), seen).collect()}
    # a stored time of 0 asks for a new look
    assert got == {("d", "/s/Work/a.pdf"): "changed", ("e", "/s/Work/a.pdf"): "changed", ("d", "/new"): "new", ("d", "/gone"): "deleted"}
    assert {r.status for r in I.changes(rows(spark, [A]), rows(spark, [A]), force=True).collect()} == {"changed"}


def test_read_text_fills_only_what_is_empty(spark):
    texts = spark.createDataFrame([("d", "/s/Work/a.pdf", "read")], "device_id string, path string, ocr_text string")
    got = {r.id: (r.content_snip, r.ocr_pending) for r in I.with_read_text(rows(spark, [A, B]), texts).collect()}
    assert got == {1: ("read", False), 3: ("y", False)}


def test_buckets_and_labels(spark):
    day = 86_400_000
    df = spark.createDataFrame([(0, 10 * 1024 - 1, "JPG"), (day, 10 * 1024, "zip"), (8 * day, 10**9, "nope")], "age long, size long, ext string")
    got = df.select(X.age_bucket(F.lit(10 * day) - F.col("age"), 10 * day).alias("a"), X.size_bucket(F.col("size")).alias("s"), X.type_label(F.col("ext")).alias("t"), X.display_size(F.col("size")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("today", "tiny", "photo image", "9 KB"), ("today", "small", "archive compressed", "10 KB"), ("this-month", "huge", "file", "953.7 MB")]


def test_tokens_scripts_and_matching(spark):
    df = spark.createDataFrame([("Q2_Budget-Final.v2.PDF", "नमस्ते hello", "smart budget"), (None, None, None), ("", "", "")], "n string, t string, m string")
    r = df.select(T.stem_of(F.col("n")).alias("s"), T.tokenize(F.col("t")).alias("k"), T.dominant_language(F.col("t")).alias("l"), T.contains_token(F.col("m"), F.lit("art")).alias("c")).collect()
    assert (r[0].s, r[0].k, r[0].l, r[0].c) == ("q2 budget final v2", ["नमस्ते", "hello"], "mixed", False)
    assert r[1].s is None and r[1].k is None and r[1].l is None and r[2].k == []
    one = spark.range(1)
    glue = lambda w, t: one.select(T.glued_match(F.lit(w), F.lit(t))).first()[0]
    assert glue("q2budget", "budget") and glue("q2budget", "q2") and not glue("smart", "art") and glue("budget", "budget") and not glue("budgets", "budget")
    assert one.select(T.match_ratio(F.array(F.lit("a")), F.array().cast("array<string>"))).first()[0] == 1.0


def test_name_and_text_signals(spark):
    r = spark.createDataFrame([("cv_anna_2024_mar_q2_12345_final", "Head line\nRs. 500 on 2024-01-02, call 9876543210, a@b.co ABCDE1234F")], "s string, t string").select(X.name_signals(F.col("s")).alias("n"), X.text_signals(F.col("t")).alias("t")).first()
    assert (r.n.year, r.n.month, r.n.quarter, r.n.person) == ("2024", "mar", "Q2", "Anna")
    assert r.t.has_amount and r.t.dates == ["2024-01-02"] and r.t.has_phone and r.t.has_email and r.t.ids == ["ABCDE1234F"] and r.t.heading == "Head line"
    assert [x[0] for x in spark.createDataFrame([(None,), ("hello world",), ("a long agreement text between two parties about many important matters of business",)], "t string").select(X.is_weak_text(F.col("t"))).collect()] == [True, True, False]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0]), ([float("nan"), 1.0], None)], "a array<float>, b array<float>")
    r = df.select(VX.unit(F.col("a")).alias("u"), VX.dot(F.col("a"), F.col("b")).alias("d"), VX.usable(F.col("a")).alias("ok")).collect()
    assert [round(x, 6) for x in r[0].u] == [0.6, 0.8] and r[0].d == 3.0 and r[1].u == [0.0, 0.0] and r[1].d is None
    assert [x.ok for x in r] == [True, False, False]


def test_enriched_queries(spark):
    df = spark.createDataFrame([("Share my old photos from Q2 on whatsapp",), ("certificate Mudith",), ("",), (None,)], "query string")
    r = enrichment.enriched(df).collect()
    assert (r[0].time_hint, r[0].action, r[0].target, r[0].quarters) == ("older", "share", "whatsapp", ["Q2"])
    assert r[1].stable_order == "certificate mudith" and r[2].core_tokens == [] and r[3].core_tokens is None


def test_events(spark):
    at = datetime
    log = spark.createDataFrame(
        [("e1", "d", at(2025, 1, 1, 10, 0, 0), at(2025, 1, 2), "Tax Return", '["/a","/tax.pdf"]'), ("e1", "d", at(2025, 1, 1, 10, 0, 0), None, "Tax Return", '["/a","/tax.pdf"]'), ("e2", "d", at(2025, 1, 1, 10, 0, 0, 300_000), None, "tax return ", "[]"), ("e3", "d", at(2025, 1, 1, 11), None, None, None)],
        "event_id string, device_id string, event_ts timestamp, received_at timestamp, query string, results string",
    )
    single = events.once(log)
    assert single.count() == 3 and single.where("event_id = 'e1'").first().received_at is not None
    golden = spark.createDataFrame([("tax return", "TAX", 2)], "query string, expected_substring string, max_shown_rank int")
    r = events.golden_report(single, golden).collect()
    assert [(x.n_searches, x.best_place, x.n_passed) for x in r] == [(2, 2, 1)]
    assert {x.event_id for x in events.settled(single).collect()} == {"e2", "e3"}
    assert events.shown(single).count() == 2
    clicks = spark.createDataFrame([("c", "d", at(2025, 1, 1, 10, 1), "Tax Return", 1, "/tax.pdf"), ("x", "d", at(2024, 1, 1), "Tax Return", 1, "/tax.pdf")], "event_id string, device_id string, event_ts timestamp, query string, clicked_rank int, clicked_path string")
    assert {(x.event_id, x.shown_place) for x in events.click_ranks(clicks, single).collect()} == {("c", 2), ("x", None)}
