"""Owners and parties on literal cases, and the rules of files."""

import pytest
from pyspark.sql import functions as F

from korrel.functions import files as X
from korrel.functions import owners as O


def one(spark, make, *values):
    kinds = {str: "string", int: "long", bool: "boolean", list: "array<string>", type(None): "string", float: "double"}
    names = "abcde"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, values))).select(make(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize("stem,want", [
    ("resume_Anna_2024", [(["anna"], "PRIMARY", 0.85)]), ("cv_passport", []), ("passport_scan_2024", []), ("Mudith_passport", [(["mudith"], "PRIMARY", 0.7)]),
    ("Anna_Berg_pan", [(["anna"], "CO_PRIMARY", 0.5), (["berg"], "CO_PRIMARY", 0.5)]), ("", []),
])
def test_owners_in_names(spark, stem, want):
    assert [tuple(o) for o in one(spark, O.owners_in_name, stem)] == want


def test_owners_of_files(spark):
    got = one(spark, O.owners_of, "passport_Anna", "Name: Anna Berg\nS/O: Otto Berg")
    assert tuple(got[0]) == (["anna", "berg"], "PRIMARY", 0.9) and (["otto", "berg"], "FATHER", 0.5) in [tuple(o) for o in got]
    assert [o.confidence for o in got] == sorted((o.confidence for o in got), reverse=True) and len(got) <= 4
    assert [tuple(o) for o in one(spark, O.owners_of, "scan_01", None, "Mira Solberg")] == [(["mira", "solberg"], "PRIMARY", 0.75)]


def test_parties(spark):
    got = one(spark, O.parties_in_text, "This NDA is made between Anna Berg and Otto Lind, 2024. Mail: mira.solberg@x.co")
    assert got[:3] == ["anna", "berg", "anna berg"] and "otto lind" in got and "mira.solberg" in got
    assert one(spark, O.parties_in_text, "the company and the party") == [] and one(spark, O.parties_in_text, None) == []
    assert one(spark, O.without_entities, "rent Anna paid", ["anna"]) == "rent paid" and one(spark, O.without_entities, "Anna", ["anna"]) == "Anna"


def test_stored_owners(spark):
    read = lambda t: [tuple(o) for o in one(spark, O.owners_of_json, t)]
    assert read('[{"tokens":["ann"],"role":"KING"},{"tokens":["bo"],"role":"FATHER","confidence":0.25}]') == [(["ann"], "PRIMARY", 0.5), (["bo"], "FATHER", 0.25)]
    assert read("broken") == read("") == read(None) == []


def test_reading_from_images(spark):
    weak, needs = (lambda t: one(spark, X.is_weak_reading, t)), (lambda *v: one(spark, X.needs_reading, *v))
    assert weak(None) and weak("short text") and not weak("x" * 30)
    assert needs("x", "/s/Documents/a.pdf", 100, 1, False) and not needs("x", "/s/DCIM/Camera/a.pdf", 100, 1, False)
    assert not needs("x", "/s/a.pdf", 100, 151, False) and not needs("x", "/s/a.pdf", 100, 1, True) and not needs("x", "/s/a.pdf", 51 * 2**20, 1, False)


def test_categories(spark):
    cats = lambda *v: one(spark, X.categories_of, *v)
    assert cats("/s/Work/report_q2.xlsx", "report_q2.xlsx", "xlsx", None) == ["WORK"]
    assert cats("/s/x/a.pdf", "a.pdf", "pdf", None) == ["EDUCATION", "IDENTITY"] and cats("/s/x/a.apk", "a.apk", "apk", None) == ["GENERAL"]
    assert cats("/s/Camera/img.jpg", "img.jpg", "jpg", None)[0] == "PERSONAL"


def test_small_columns(spark):
    assert one(spark, X.compact_size, 2048) == "2KB" and one(spark, X.score_percent, 1.5) == 100 and one(spark, X.score_percent, 0.256) == 25
    assert one(spark, X.name_marks, "2024_report_q2_final") == ["dated", "versioned", "quarterly"] and one(spark, X.is_telling, "a\nb") and not one(spark, X.is_telling, "a") and not one(spark, X.is_telling, None)
    assert one(spark, lambda t: X.said_signals(X.text_signals(t)), "Head line\nRs. 5 a@b.co 2024-01-02") == "financial amounts email address dated 2024-01-02 head line"
    assert one(spark, lambda t: X.said_name(X.name_signals(t)), "cv_anna_mar_2024_v2") == "Anna mar 2024"
    assert one(spark, lambda t: X.age_in_words(t, 10**9), 10**9 - 3 * 3_600_000) == "3 hr ago"
