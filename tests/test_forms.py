"""Query forms on literal cases."""

import pytest
from pyspark.sql import functions as F

from korrel.functions import forms as Q
from korrel.functions import text as T
from korrel.functions import values as V


def one(spark, column, *values):
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip("abc", values))
    return spark.createDataFrame([values], schema).select(column).first()[0]


@pytest.fixture(autouse=True)
def columns(spark):
    global A, B
    A, B = F.col("a"), F.col("b")


def test_spoken_queries_keep_owner_and_language(spark):
    assert one(spark, Q.spoken(A), "find my aadhaar info please") == "my aadhaar"
    assert one(spark, Q.spoken(A), "mera PAN card dhundo") == "my pan card"
    assert one(spark, Q.spoken(A), "find python notes in hindi") == "python notes in hindi"
    assert one(spark, Q.spoken(A), None) is None or one(spark, Q.spoken(A), "") == ""


def test_persons_and_documents(spark):
    person = lambda *t: one(spark, Q.asks_for_person(A), list(t))
    assert person("mudith") and person("john", "smith")
    assert not person("mudith", "certificate") and not person("sarah", "passport") and not person("a", "b", "c") and not person("2024")


def test_whose_files(spark):
    name = ["mudith", "shetty"]
    owner = lambda q, own=name, **k: one(spark, Q.named_owner(A, own, **k), q)
    assert owner("Anna's passport") == ["anna"] and owner("resume for Anna Berg") == ["anna", "berg"] and owner("my pancard") == []
    assert owner("holi video") == [] and owner("holi video", by_words=False) == ["holi"]
    assert one(spark, Q.own_groups(A, ["mudith", "raj", "shetty"]), ["my", "pancard"]) == [["mudith", "pancard"], ["raj", "pancard"], ["shetty", "pancard"]]
    assert one(spark, Q.own_groups(A, []), ["my"]) == []
    assert Q.identity_tokens(["a"]) == (["a"], []) and Q.identity_tokens(["a", "b", "c"]) == (["a", "c"], ["b"])


def test_kind_of_file(spark):
    kind = lambda q, c: one(spark, Q.asked_type(A, B), q, c)
    assert kind("document", "document") == "document" and kind("tax document", "tax document") is None and kind("word document", "word document") == "document" and kind("holiday photo", "holiday photo") == "photo image"


def test_language_of_files(spark):
    fits = lambda lang, name, body: one(spark, Q.language_factor(A, B, F.col("c")), lang, name, body)
    f = V.LANGUAGE_FACTORS
    assert fits("hindi", "नोट्स.pdf", "") == f["name"] and fits("hindi", "notes.pdf", "नमस्ते") == f["none"] and fits("hindi", "12345", "hindi language") == f["body"] and fits(None, "x", "y") == 1.0


def test_expansion(spark):
    assert one(spark, Q.with_synonyms(A), "cv notes").startswith("cv notes resume biodata portfolio study")
    assert set(one(spark, Q.aliases_of(A), ["cv"])) == {"resume", "cv", "biodata", "lebenslauf", "रिज्यूम"}
    assert "hindi devanagari" in one(spark, Q.index_extras(A, B), "notes_2", "नमस्ते") and one(spark, Q.index_extras(A, B), "", None) == ""
    assert one(spark, T.words(["x"]), "q") == ["x"]
