"""Retrieval against small brute-force versions."""

import math

from korrel.operators import retrieval as R

FILES = "id long, name string, content_snip string, metadata_str string, entities string, extension string"


def files(spark):
    return spark.createDataFrame(
        [(1, "tax_return.pdf", "my tax return", "x", None, "pdf"), (2, "tax.txt", None, "", "", "txt"), (3, "photo.jpg", "beach return", None, "tax", "jpg"), (4, "tax_return_old.pdf", "tax", "tax", None, "pdf")], FILES
    )


def asked(spark, *queries):
    return spark.createDataFrame([(q, q) for q in queries], "qid string, query string")


def test_full_and_tiered_matches(spark):
    q = asked(spark, "return tax", "zzz", "")
    assert {(r.qid, r.id) for r in R.full_matches(q, files(spark), ["name"]).collect()} == {("return tax", 1), ("return tax", 4)}
    got = {(r.id, r.tier) for r in R.tiered_matches(q, files(spark), 3).collect()}
    assert got == {(1, "strict"), (4, "strict"), (2, "relaxed")}
    assert {r.id for r in R.tiered_matches(q, files(spark), 2).collect()} == {1, 4}


def test_bm25_matches_the_formula(spark):
    docs = spark.createDataFrame([(1, "tax tax return"), (2, "tax of the year gone by"), (3, "beach photo"), (4, None), (5, "sea")], "id long, text string")
    got = {r.id: r.score for r in R.bm25(asked(spark, "tax return"), docs, "id", "text").collect()}
    texts = {1: ["tax", "tax", "return"], 2: ["tax", "of", "the", "year", "gone", "by"], 3: ["beach", "photo"], 5: ["sea"]}
    mean = sum(map(len, texts.values())) / 4
    want = {}
    for i, t in texts.items():
        s = 0.0
        for w in ("tax", "return"):
            n = sum(w in x for x in texts.values())
            if w in t:
                s += max(math.log((4 - n + 0.5) / (n + 0.5)), 1e-6) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean))
        if any(w in t for w in ("tax", "return")):
            want[i] = s
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_lexical_prefers_names(spark):
    got = {r.id: r.score for r in R.lexical(asked(spark, "tax return"), files(spark)).collect()}
    assert got[1] == 200 + 35 * 2 + 80 + 100 and got[1] > got[4] > got[2] and got[3] == 35 + 55


def test_fusion_and_ranks(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, id long, place int")
    b = spark.createDataFrame([("q", 2, 1)], "qid string, id long, place int")
    got = [(r.id, r.place) for r in R.fused([(a, 1.5), (b, 1.0)], 5).orderBy("place").collect()]
    assert got == [(2, 1), (1, 2)]
    scored = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.5), ("q", 3, 0.9)], "qid string, id long, score double")
    assert {(r.id, r.rank) for r in R.rank_of(scored, scored.where("id < 3").select("qid", "id")).collect()} == {(1, 2), (2, 2)}
    near = R.nearest(spark.createDataFrame([("q", [1.0, 0.0])], "qid string, q array<float>"), spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "id long, v array<float>"), 2)
    assert [(r.id, r.place) for r in near.orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_limits():
    assert (R.limits(500)["dense"], R.limits(10_000)["dense"], R.limits(24_000)["dense"], R.limits(24_000)["fused"], R.limits(24_000)["rerank_pool"], R.limits(24_000)["keyword"]) == (50, 120, 350, 96, 180, 2200)


def test_coverage_pool_and_weak_queries(spark):
    q = asked(spark, "tax return", "zzz")
    got = {r.id: (r.name_share, r.query_share, r.is_title) for r in R.coverage(q, files(spark)).collect()}
    assert got[1] == (1.0, 1.0, True) and got[2] == (1.0, 0.5, False) and got[4][2] is False
    a = spark.createDataFrame([("q", 5, 1), ("q", 6, 2)], "qid string, id long, ord int")
    b = spark.createDataFrame([("q", 6, 1), ("q", 7, 2)], "qid string, id long, ord int")
    assert [(r.id, r.tier, r.pos) for r in R.pooled([(a, False), (b, True)], 1).orderBy("pos").collect()] == [(5, 0, 1), (6, 0, 2), (7, 1, 3)]
    scored = spark.createDataFrame([("tax return", 1, 9.0)], "qid string, id long, score double")
    assert {(r.qid, r.n) for r in R.weak_queries(q, scored, 5.0).collect()} == {("zzz", 0)}


def test_stored_postings_read_only_asked_tokens(spark, tmp_path):
    R.store_postings(files(spark), str(tmp_path / "p"), 16)
    q = asked(spark, "tax return", "zzz")
    got = R.stored_postings(q, str(tmp_path / "p"), buckets=16)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in R.postings(files(spark)).where("token IN ('tax', 'return')").collect()}
    assert "PartitionFilters: [bucket" in got._jdf.queryExecution().toString() or "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().toString()
    assert R.stored_postings(q, str(tmp_path / "p"), [], 16).count() == 0


def test_pins_come_in_for_the_last_others(spark):
    from korrel.operators import search as SE

    rows = [("q", i, 1.0 - i / 10, i in (0, 6, 7)) for i in range(9)]
    got = SE.with_pins(spark.createDataFrame(rows, "qid string, id long, score double, pin boolean"), 4)
    assert [r.id for r in got.orderBy("place").collect()] == [0, 1, 6, 7]
    a, b = (spark.createDataFrame(x, "qid string, id long, score double") for x in ([("p", 1, 0.5), ("q", 1, 0.1)], [("p", 2, 0.52), ("q", 2, 0.1), ("r", 3, 0.1)]))
    assert {(r.qid, r.id) for r in SE.better_of(a, b).collect()} == {("p", 1), ("q", 2), ("r", 3)}
