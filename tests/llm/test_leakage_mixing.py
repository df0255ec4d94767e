"""Leaked passages against brute force; the mix against its shares, caps and schedule."""

import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korrel.llm import leakage as L
from korrel.llm import mixing as M
from korrel.llm import tokens as K


def bare(text):
    """Words by another way than the operator's: decomposed, folded, marks stripped one by one."""
    out = []
    for raw in (text or "").split():
        w = unicodedata.normalize("NFC", unicodedata.normalize("NFD", raw).casefold())
        while w and unicodedata.category(w[0])[0] in "PSZC":
            w = w[1:]
        while w and unicodedata.category(w[-1])[0] in "PSZC":
            w = w[:-1]
        out += [w] if w else []
    return out


def brute(text, items, least):
    words = bare(text)
    runs = {tuple(words[i : i + least]) for i in range(len(words) - least + 1)}
    out = set()
    for item, t in items:
        ws = bare(t)
        if any(tuple(ws[i : i + least]) in runs for i in range(len(ws) - least + 1)):
            out.add(item)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B,", "(c", "**d**", "-", "é.", "GROẞE", "große,", "σοφος.", "İ)", "e\u0301"]), max_size=30), st.lists(st.lists(st.sampled_from(["A", "b", "c", "d", "É", "grosse", "ΣΟΦΟΣ", "i̇"]), max_size=9), max_size=4), st.integers(2, 5))
def test_same_as_brute_force(doc, items, least):
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    text = "  ".join(doc)
    assert {p[0] for p in L.Matcher(items, least).passages(text)} == brute(text, items, least)


def test_letter_case_next_to_punctuation():
    item = "eins zwei drei vier fünf sechs sieben acht neun zehn elf große"
    m = L.Matcher([(1, item), (2, "der " * 11 + "σοφος")], 12)
    for end in ("große", "große.", "GROSSE", "„große“", "Große…"):
        assert [p[0] for p in m.passages("so " + item.replace("große", end) + " ist")] == [1]
    assert [p[0] for p in m.passages("DER, " * 11 + "ΣΟΦΟΣ!")] == [2]


def test_the_longest_passage_of_each_place():
    m = L.Matcher([(1, "a b c a b c d")], 3)
    assert m.passages("x a b c d y a b c") == [(1, 2, 9, 4), (1, 12, 17, 3)]


def test_places_lead_back_to_the_text():
    text = "Intro – “ONE,  two\n**three** four” end"
    assert L.Matcher([(7, "one two three four")], 4).passages(text) == [(7, 8, 34, 4)]
    assert text[8:34] == "“ONE,  two\n**three** four”"
    assert L.Matcher([], 4).passages(text) == [] and L.Matcher([(7, "one two")], 4).passages(text) == []


def test_leaks_on_tables(spark):
    items = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A b. c d y", "e"), (2, None, "e"), (3, "", "e"), (4, "a b c", "e"), (5, "z " * 50_000 + "a b c d", "e")], "doc_id long, text string, item_id string")
    assert {tuple(r) for r in L.leaks(docs, items, 4).collect()} == {(1, 1), (1, 2), (5, 1), (5, 2)}
    assert L.leaks(docs.where("false"), items, 4).count() == 0 and L.leaks(docs, items.where("false"), 4).count() == 0


def test_groups_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i} x y z") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "w0 x y z w4 x y z")], "doc_id long, text string")
    monkeypatch.setattr(L, "GROUP_WORDS", 7)
    assert {tuple(r) for r in L.leaks(docs, items, 4).collect()} == {(1, 0), (1, 4)}


def deviation(shares, n_frames, frame):
    """The largest distance of any source from its exact share after any slot, in blocks."""
    weights = M.weights_of(shares)
    edges = M.boundaries(weights, {s: int(w * n_frames * frame) for s, w in weights.items()}, frame)
    order = []
    for f in range(n_frames):
        plan = M.frame_schedule(weights, *({s: e[f + k] for s, e in edges.items()} for k in (0, 1)), f * frame)
        assert sorted(x for own in plan.values() for x in own) == list(range(f * frame, (f + 1) * frame))
        assert all(own == sorted(own) and len(own) == edges[s][f + 1] - edges[s][f] for s, own in plan.items())
        # every block within its window is the same as less than one block from the exact share
        assert all(M.release(e, weights[s]) <= slot < M.deadline(e, weights[s]) for s, own in plan.items() for e, slot in enumerate(own, edges[s][f]))
        order += sorted((slot, s) for s, own in plan.items() for slot in own)
    names = sorted(weights)
    done = np.cumsum(np.array([s for _, s in order])[:, None] == np.array(names), axis=0)
    share = np.array([float(weights[s]) for s in names])
    return np.abs(done - np.arange(1, len(done) + 1)[:, None] * share).max()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.01, 1), min_size=1), st.sampled_from([7, 50, 200]))
def test_schedule_is_pfair(shares, frame):
    assert deviation(shares, 12, frame) < 1 + 1e-9


def test_shares_hold_over_a_million_blocks():
    # weights that are no multiples of a power of ten
    assert deviation({"a": 1 / 3, "b": 1 / 7, "c": 1 / 11, "d": 0.0001234567, "e": 1 - 1 / 3 - 1 / 7 - 1 / 11}, 64, M.FRAME) < 1


@pytest.fixture
def corpus(spark):
    texts = [(i, "big" if i % 3 else "small", "word " * (5 + i % 7)) for i in range(60)] + [(100, None, "x"), (101, "other", "x"), (102, "big", ""), (103, "big", None)]
    return spark.createDataFrame(texts, "doc_id long, source string, text string")


def test_mix(spark, corpus):
    aims = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, None), ("zero", 0.0, None)], "source string, target_share double, max_repeats int")
    rows = M.mix(corpus, aims, block_tokens=20).collect()
    assert {r.source for r in rows} == {"big", "small"} and not {r.doc_id for r in rows} & {100, 101, 102, 103}
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.use_no)
    assert all(sorted(u) == list(range(1, len(u) + 1)) for u in uses.values())
    assert max(len(u) for (s, _), u in uses.items() if s == "big") == 1 and max(len(u) for (s, _), u in uses.items() if s == "small") <= 3
    report = {r.source: r for r in M.mix_report(corpus, aims, block_tokens=20).collect()}
    assert abs(report["big"].reached_share - 5 / 9) < 0.03 and report["none"].mix_tokens == 0 and report["zero"].reached_share == 0
    # the same blocks of a source never stand in two slots, and a source's blocks keep their order
    by_block = {}
    for r in rows:
        by_block.setdefault((r.source, r.block_no), set()).add(r.slot)
    assert all(len(s) == 1 for s in by_block.values())


def test_mix_of_nothing(spark, corpus):
    aims = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert M.mix(corpus.where("false"), aims).count() == 0 and M.mix(corpus, aims.where("false")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",), ("ab " * 40_000,)], "text string")
    got = [r.n_tokens for r in K.with_token_counts(df).collect()]
    assert got[1:3] == [0, 0] and got[0] == K.count("a b") and got[3] == K.count("ab " * 40_000)
