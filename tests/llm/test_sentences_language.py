"""Sentence units and language segments of small texts, with models trained on small corpora."""

from hypothesis import given, settings
from hypothesis import strategies as st

from korrel.llm import language as G
from korrel.llm import sentences as S


def corpus():
    names = ["Anna", "Bert", "Carla", "Dora"]
    out = []
    for i in range(160):
        out.append(f"The old report {i} was kept. Dr. {names[i % 4]} signed page no. {i} of it. See fig. {i} and app. B.\n\nMy copy is on the shelf. We close at 5.30 p.m. The form is lost!\n\nOn Monday all was well. Is it here? Yes. The box (it is old. Very old!) broke. \"Who is it?\" asked {names[i % 4]} again. We have etc. and more.")
        out.append(f"Der Antrag Nr. {i} liegt vor. Am {i % 28 + 1}. Mai war Dr. {names[i % 4]} da.\n\nDie Kopie ist gut. Das Formular fehlt.")
    return out


def model(texts):
    seen = {}
    for t in texts:
        S.count_text(t, seen)
    counts = S.Counts(S.cells_of(seen))
    return S.fit([e for t in texts for e in S.examples(t, counts)], 150), counts


WEIGHTS, COUNTS = model(corpus())


def split(text):
    return [text[a:b] for a, b in S.units(text, WEIGHTS, COUNTS)]


def test_abbreviations_and_layout():
    assert split("Dr. Anna signed no. 5 of it. The form is lost!") == ["Dr. Anna signed no. 5 of it.", "The form is lost!"]
    assert split("Heading here\n\n- one thing\n- two things.\n1. third\n2. fourth") == ["Heading here", "- one thing", "- two things.", "1. third", "2. fourth"]
    assert split("[01/09 12:26] Bert: The copy is good\n[02/09 08:00] Anna: My copy is lost. The form is here.") == ["[01/09 12:26] Bert: The copy is good", "[02/09 08:00] Anna: My copy is lost.", "The form is here."]
    assert split("The clerk (he came late. Again!) signed\nboth pages. My copy is good.") == ["The clerk (he came late. Again!) signed\nboth pages.", "My copy is good."]
    assert split("我们在这里。你在哪里？注意！") == ["我们在这里。", "你在哪里？", "注意！"]
    assert split("words without any mark\nof an end") == ["words without any mark\nof an end"]
    assert split(None) == split("") == split(" \n\n ") == []


def test_a_wrapped_ordinal_is_no_list_item():
    assert [b.kind for b in S.blocks("Er kam am\n2. Mai an.")] == ["text"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB.!? \n\"()“”1-•。ก|[]:", max_size=60))
def test_units_cover_every_character_once(text):
    got = S.units(text, WEIGHTS, COUNTS)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
    assert sum(not c.isspace() for a, b in got for c in text[a:b]) == sum(not c.isspace() for c in text)


def test_counts_need_evidence_and_no_share_of_the_corpus():
    seen = {("start", "the", True): 50, ("start", "rare", True): S.EVIDENCE - 1, ("end", "abk", False): 30, ("end", "day", True): 10, ("end", "day", False): 30}
    for more in (0, 10**7):  # a word of any corpus size
        counts = S.Counts(S.cells_of(seen | {("start", "a", True): more, ("end", "b", True): more}))
        assert counts.share("end", "abk") == 0 and counts.share("end", "day") == 0.25 and counts.share("end", "none") is None
        assert counts.share("start", "rare") is None and abs(counts.share("start", "the") - 50 / (69 + more)) < 1e-9


def test_held_out_accuracy():
    right = total = 0
    for i in range(200, 240):
        text = f"The old report {i} was kept. Dr. Bert signed page no. {i} of it. My copy is on the shelf. On Monday all was well."
        right += split(text) == [f"The old report {i} was kept.", f"Dr. Bert signed page no. {i} of it.", "My copy is on the shelf.", "On Monday all was well."]
        total += 1
    assert right / total >= 0.9


def test_units_on_tables(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(corpus()[:40])] + [(900, None, "x"), (901, "", "x"), (902, "My copy is good. " * 3000, "x")], "doc_id long, text string, start_pos string")
    rows = S.sentence_units(docs).collect()
    assert sum(r.doc_id == 902 for r in rows) == 3000 and not [r for r in rows if r.doc_id in (900, 901)]
    assert S.sentence_units(docs.where("false")).count() == 0


TEXTS = {
    "en": "The last invoice was rejected by the front desk and nobody noticed the change. We keep both copies of the lease agreement.",
    "de": "Die letzte Rechnung wurde vom Amt zurückgeschickt und niemand hat es bemerkt. Wir behalten beide Kopien des Vertrags.",
    "es": "La última factura fue devuelta por la ventanilla y nadie se dio cuenta. Guardamos las dos copias del contrato.",
    "hi": "पिछले महीने की रसीद दफ़्तर से वापस आई है और किसी ने ध्यान नहीं दिया। दोनों प्रतियाँ रख लीजिए।",
    "ja": "先月の請求書は二部印刷する必要があり誰も気づきませんでした。",
    "zh": "上个月的发票被窗口退了回来，但是没有人注意到。",
}
RANKS = G.ranks_of(G.train([(k, v) for k, v in TEXTS.items()] * 3))


def langs(text):
    return [s[2] for s in G.segments(text, RANKS)]


def test_segments():
    for code, text in TEXTS.items():
        assert langs(text) == [code]
    mixed = f"{TEXTS['en']} {TEXTS['hi']}\n{TEXTS['de']}"
    assert langs(mixed) == ["en", "hi", "de"]
    assert langs(f"{TEXTS['de']} Anna Berg, 030 1234567, a@b.co.") == ["de"]
    assert langs(None) == langs(" ") == [] and langs("12345 !!") == ["und"]
    assert langs("राम की रसीद दफ़्तर से invoice_3.pdf वापस आई है।") == ["hi"]
    parts = G.segments(mixed, RANKS)
    assert all(0 <= p[3] <= 1 for p in parts) and mixed[parts[1][0] : parts[1][1]] == TEXTS["hi"]


def test_labels_are_mended(spark):
    files = spark.createDataFrame(
        [(i, TEXTS[c], TEXTS[c] + " A work pdf document named x last modified today stored in Work", "z") for i, c in enumerate(["en", "de", "es", "hi"] * 6)] + [(50, None, "", "z"), (51, TEXTS["en"] + " " + TEXTS["hi"], None, "z")],
        "id long, content_snip string, metadata_str string, lang string",
    )
    good = [(i, c) for i, c in enumerate(["EN", "ger", "Spanish", "hin"] * 6)]
    labels = spark.createDataFrame([x for x in good if x[0] not in (4, 5)] + [(5, "en"), (6, "spa"), (51, "en"), (99, "fr")], "file_id long, lang string")
    rows = {(r.id, r.field, r.seg_no): r.lang for r in G.mended_labels(files, labels).collect()}
    assert {k[0] for k in rows} == {4, 5, 51}
    assert rows[5, "content_snip", 1] == "de" and rows[5, "metadata_str", 2] == "en" and rows[51, "content_snip", 2] == "hi"
    assert G.mended_labels(files.where("false"), labels).count() == 0
