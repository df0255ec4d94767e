"""Packed fields: layouts, positions, protection, and the choice between dialects."""

from korrel.operators.packed import parses, split_quoted, unpack

SCHEMA = "id long, categories string, owner_names string, entities string, item string"


def found(spark, rows):
    return {(r.id, r.field, r.pos, r.item) for r in unpack(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_quotes_and_escapes_protect():
    assert split_quoted('"a, b";c', ",;", True) == [("a, b", True), ("c", False)]
    assert split_quoted("a\\, b; c", ",;", True) == [("a, b", False), ("c", False)]
    assert split_quoted('"say ""x"""|d', "|", True) == [('say "x"', True), ("d", False)]
    assert split_quoted(" ;; ", ";", True) == []


def test_layouts(spark):
    rows = [
        (1, "WORK,MEDIA", '[{"tokens":["ann","lee"],"role":"PRIMARY"},{"tokens":["bo","ek"]}]', "kyc visa", "x"),
        (2, "WORK / MEDIA", "['Ann Lee', 'Lee, Bo']", '"kyc"|"1 road, town 00001"', "x"),
        (3, "work;", "Ann Lee & Bo Ek", "kyc | visa;rent, 2024", None),
        (4, None, "", "[]", None),
        (5, "WORK", "M/s Ek Ltd", "kyc", None),
        (6, "WORK", "[broken, 'Ann'", ";;", None),
        (1, "WORK,MEDIA", '[{"tokens":["ann","lee"],"role":"PRIMARY"},{"tokens":["bo","ek"]}]', "kyc visa", "x"),
    ]
    got = found(spark, rows)
    assert {x for x in got if x[0] == 1} == {(1, "categories", 1, "WORK"), (1, "categories", 2, "MEDIA"), (1, "owner_names", 1, "ann lee"), (1, "owner_names", 2, "bo ek"), (1, "entities", 1, "kyc"), (1, "entities", 2, "visa")}
    assert {x for x in got if x[0] == 2} == {(2, "categories", 1, "WORK"), (2, "categories", 2, "MEDIA"), (2, "owner_names", 1, "Ann Lee"), (2, "owner_names", 2, "Lee, Bo"), (2, "entities", 1, "kyc"), (2, "entities", 2, "1 road, town 00001")}
    assert {x[3] for x in got if x[0] == 3 and x[1] == "entities"} == {"kyc", "visa", "rent", "2024"}
    assert {x[3] for x in got if x[0] == 3 and x[1] == "owner_names"} == {"Ann Lee", "Bo Ek"}
    assert not [x for x in got if x[0] in (4, 5)]


def test_frequent_values_decide(spark):
    # "a, b" is a value of its own wherever it is protected, so the bare one is split by ; only
    rows = [(i, "x", '"lee, ann"; "ek, bo"', None, None) for i in range(20)] + [(99, "x", "ek; bo, lee", None, None)]
    assert {x[3] for x in found(spark, rows) if x[0] == 1} == {"lee, ann", "ek, bo"}


def test_empty_table_and_long_text(spark):
    assert found(spark, []) == set()
    many = ",".join(f"v{i}" for i in range(5000))
    assert len(found(spark, [(1, many, None, None, None)])) == 5000


def test_parses_of_blank():
    assert parses("categories", "  ") == [] and parses("categories", None) == []
