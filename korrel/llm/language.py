"""Language of texts and of the one-language segments of mixed texts, by rank-order profiles.

A profile lists a language's most frequent character n-grams in the order of their frequency. A
sentence is compared with each profile of its script by the out-of-place distance: the sum over the
sentence's own ranked n-grams of how far each is from its place in the profile, with a fixed distance
for n-grams the profile lacks. The nearest language wins; the confidence is how much nearer it is
than the second. Neighbouring sentences of one language form a segment; a sentence with too little
text of its own (names, numbers, file names) joins its neighbour.

The profiles are trained on labelled files: of each label the ``TRAIN_FILES`` of the smallest
hashes. As labels may be wrong, training is repeated on the sentences that the profiles give to
their own label.

Defined results: null, empty and blank texts have no segments; a text without letters is one segment
of language ``und`` and confidence 0; ties go to the code that sorts first; repeated label rows count once.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labelled files of each language that the profiles are trained on, at most.
TRAIN_FILES = 600
#: n-grams of a profile, and of a sentence.
PROFILE, OWN = 1200, 400
#: Letters below which a sentence has too little text of its own, and the least confidence it needs,
#: times the root of its letters.
LEAST_LETTERS, LEAST_CONFIDENCE = 12, 1.6

# The languages with their scripts, and the ways to write a label.
SCRIPT_OF = {
    "en": "Latin", "de": "Latin", "fr": "Latin", "es": "Latin", "pt": "Latin", "hi-Latn": "Latin", "hi": "Devanagari", "mr": "Devanagari",
    "ta": "Tamil", "bn": "Bengali", "zh": "Han", "ja": "Kana", "th": "Thai",
}
NAMES_OF = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol",
    "pt": "pt por portuguese português portugues", "hi-Latn": "hi-latn hin-latn hinglish hi_latn", "hi": "hi hin hindi हिन्दी हिंदी", "mr": "mr mar marathi मराठी",
    "ta": "ta tam tamil தமிழ்", "bn": "bn ben bengali bangla বাংলা", "zh": "zh zho chi chinese cmn zh-cn zh-hans 中文", "ja": "ja jpn japanese 日本語", "th": "th tha thai ไทย",
}
#: Scripts that a sentence without letters of its own kind may share.
FAMILY = {"Kana": "Han"}
LABELS = {name: code for code, names in NAMES_OF.items() for name in names.split()}

SCRIPTS = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Devanagari", "Tamil", "Bengali", "Han", "Thai")} | {"Kana": regex.compile(r"[\p{Hiragana}\p{Katakana}]")}
#: What says nothing about the language: addresses of mail and web, file names, words with digits.
MAIL = regex.compile(r"(?<![\p{Latin}\d._+\-])[\p{Latin}\d._+\-]*+ ?(?:@ ?|\((?:at)\) ?)[\p{Latin}\d.\-]*+(?: ?\((?:dot)\) ?[\p{Latin}\d.\-]++)*")
FILE = regex.compile(r"\b(?:https?:|www\.)[\p{Latin}\d./\-]++|(?<![\p{Latin}\d._\-])[\p{Latin}\d()_\-]++(?:\.[\p{Latin}\d_\-]++)*(?<=\.(?:pdf|jpg|png|doc|xls|csv|ppt|txt|zip|mp3|mp4|jpeg|docx|xlsx|pptx))")
DIGITS = regex.compile(r"(?<![\p{Latin}\d+/.,:()_\-])[\p{Latin}+/.,:()_\-]*+\d[\p{Latin}\d+/.,:()_\-]*+")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}'’]+")
HAS_DIGIT, HAS_LETTER = regex.compile(r"\d"), regex.compile(r"[A-Za-z]")
LATIN_WORD = regex.compile(r"[\p{Latin}][\p{Latin}\p{M}'’.\-]*")
NAME_WORD = regex.compile(r"\p{Lu}[\p{L}\p{M}'’.\-]*")
#: Ends of sentences: end marks with closing marks, lone bars and slashes, line breaks.
END = regex.compile(r"(?<=[!?…।॥][\"”»)]?)\s+|(?<=[。！？][」』”）]?)\s*(?=\S)|\s+[|/]\s+|\s*\n\s*|(?<=\.[\"”»)]?)\s+")
SHORT = regex.compile(r"(?:^|(?<!\d)[\s(。、：])(?:\p{L}|[A-Z]\.[A-Z]|Dr|Mr|Mrs|Ms|Prof|Rev|Sr|Sra|Dra|Mme|St|No|Nr|Rd|Ave?|Avda|Str|H\.No|Apt|Hrn?|Mohd|Smt|Shri|c|R|incl|Ltd|Pvt|Inc|Co|डॉ|श्री|सौ|डॉक्टर|திரு|டாக்டர்|นพ|Tel|Nº|n|cc)\.$")
#: A closing phrase that describes the file.
CLOSING = regex.compile(r"\bAn? (?:\p{L}+ ){1,5}named ")
#: Where a stretch of Latin words may begin in a text of a script without end marks.
FOREIGN = regex.compile(r"(?<=\S)\s+(?=(?:\p{Latin}[\p{Latin}'’,]*\s+){3,})")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, good enough to find changes of language."""
    closing = -1
    for m in CLOSING.finditer(text):
        closing = m.start()
    cuts: list[tuple[int, int]] = []
    for m in END.finditer(text):
        before = text[max(0, m.start() - 14) : m.start()]
        if before.endswith(".") and m.group().isspace() and "\n" not in m.group() and SHORT.search(before):
            continue
        cuts.append((m.start(), m.end()))
    if SCRIPTS["Thai"].search(text):
        inside = False  # within a Latin stretch already
        for m in FOREIGN.finditer(text):
            latin = SCRIPTS["Latin"].match(text[m.start() - 1]) is not None
            if sum(w[:1].islower() for w in text[m.end() : m.end() + 60].split()[:4]) >= 2 and not (latin and inside):
                cuts.append((m.start(), m.end()))
                inside = True
            elif not latin:
                inside = False
        cuts += [(m.start(), m.end()) for m in regex.finditer(r"(?<=\p{Thai})\s+(?=[\p{Thai}\p{Devanagari}\p{Tamil}\p{Bengali}\p{Han}])|(?<=[\p{L}\p{M}\d.])\s+(?=\p{Thai}{6,})", text)]
    if closing > 0:
        start = closing
        while start > 0 and text[start - 1].isspace():
            start -= 1
        cuts.append((start, closing))
    out, at = [], 0
    for a, b in [*sorted(set(cuts)), (len(text), len(text))]:
        if a < at:
            continue
        s, e = at, a
        while s < e and text[s].isspace():
            s += 1
        if s < e:
            out.append((s, e))
        at = b
    return out


def without_noise(text: str) -> str:
    """A sentence without what says nothing about its language."""
    if "@" in text or "(at)" in text:
        text = MAIL.sub(" ", text)
    if "." in text:
        text = FILE.sub(" ", text)
    return DIGITS.sub(" ", text) if HAS_DIGIT.search(text) else text


def script_of(text: str) -> str:
    """The script of a sentence without noise: the one of most letters, but Latin only if others
    have few."""
    if text.isascii():
        return "Latin" if HAS_LETTER.search(text) else ""
    n = {s: len(p.findall(text)) for s, p in SCRIPTS.items()}
    others = {s: k for s, k in n.items() if s != "Latin"}
    if n["Kana"]:
        return "Kana"
    best = max(sorted(others), key=lambda s: others[s])
    # names may outweigh the other words of a sentence; a foreign word or two don't make it foreign
    if others[best] * (8 if best == "Han" else 6 if others[best] >= 4 else 1.5) >= n["Latin"] and others[best]:
        return best
    return "Latin" if n["Latin"] else ""


def own_words(text: str, script: str) -> str:
    """What tells the language of a sentence without noise: its words without names."""
    if script != "Latin":
        text = LATIN_WORD.sub(" ", text)
    else:
        words = text.split()
        text = " ".join(w for i, w in enumerate(words) if not (i and (w[0].isupper() or not w[0].isalpha()) and NAME_WORD.fullmatch(w.strip("(),;:.\"'„“"))) and not (len(w) > 2 and w.isupper()))
    return " ".join(NOT_LETTERS.sub(" ", text.lower()).split())


def grams(text: str) -> Counter:
    """Counts of the n-grams of 1 to 4 characters, with blanks at the ends."""
    t = f" {text} "
    out = Counter(t)
    for n in (2, 3, 4):
        out.update(map("".join, zip(*[t[i:] for i in range(n)])))
    out.pop(" ", None)
    return out


def ranked(counts: Counter, most: int) -> list[str]:
    """The most frequent n-grams, first the most frequent; ties in code-point order."""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


Profiles = dict[str, dict[str, int]]


class Ranks:
    """Profiles of one script side by side: a row of places for every n-gram that any of them has."""

    def __init__(self, profiles: Profiles, script: str) -> None:
        self.languages = [x for x in sorted(profiles) if SCRIPT_OF[x] == script]
        every = sorted({g for x in self.languages for g in profiles[x]})
        self.rows = {g: i for i, g in enumerate(every)}
        self.places = np.full((len(every) + 1, max(len(self.languages), 1)), 10 * PROFILE, dtype=np.int32)
        for j, x in enumerate(self.languages):
            for g, i in profiles[x].items():
                self.places[self.rows[g], j] = i

    def distances(self, text: str) -> list[tuple[float, str]]:
        """(mean out-of-place distance of an n-gram, language), nearest first."""
        counts = grams(text)
        own = sorted(counts, key=counts.__getitem__, reverse=True)[:OWN]  # ties: first seen first
        last = len(self.rows)
        rows = list(map(self.rows.get, own, itertools.repeat(last)))
        away = np.minimum(np.abs(self.places[rows] - np.arange(len(own))[:, None]), PROFILE)
        return sorted(zip((away.sum(axis=0) / max(len(own), 1)).tolist(), self.languages))


def ranks_of(profiles: Profiles) -> dict[str, Ranks]:
    """The profiles by script."""
    return {script: Ranks(profiles, script) for script in sorted({SCRIPT_OF[x] for x in profiles})}


def classify(text: str, ranks: dict[str, Ranks], known: dict | None = None) -> tuple[str, float, int, str]:
    """(language, confidence, letters, script) of one sentence; ``und`` without letters."""
    if known is not None and text in known:
        return known[text]
    bare = without_noise(text)
    script = script_of(bare)
    own = own_words(bare, script)
    letters = sum(map(str.isalpha, own))
    if not letters or script not in ranks:
        got = ("und", 0.0, 0, script)
    else:
        ds = ranks[script].distances(own)
        second = ds[1][0] if len(ds) > 1 else PROFILE
        got = (ds[0][1], round(max(0.0, 1 - ds[0][0] / max(second, 1e-9)), 4), letters * (3 if script in ("Han", "Kana") else 1), script)
    if known is not None and len(known) < 200_000:
        known[text] = got
    return got


def segments(text: str | None, ranks: dict[str, Ranks], known: dict | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the segments of a text, in reading order."""
    if not text or not text.strip():
        return []
    parts = [(a, b, *classify(text[a:b], ranks, known)) for a, b in sentences(text)]
    if not parts:
        return []
    alone = {s for s, r in ranks.items() if len(r.languages) == 1 and s != "Han"}
    sure = [p[4] >= LEAST_LETTERS and (p[3] * p[4] ** 0.5 >= LEAST_CONFIDENCE or p[5] in alone) for p in parts]
    langs: list[str] = []
    closing = len(parts) - 1 if len(parts) > 1 and CLOSING.match(text, parts[-1][0]) else len(parts)
    for i, p in enumerate(parts):
        if i == closing:
            langs.append("en")  # by definition, and no neighbour to any other sentence
            continue
        near = [j for j in (i - 1, i + 1) if 0 <= j < closing and sure[j]]
        if sure[i] or any(parts[j][2] == p[2] for j in near):
            langs.append(p[2])
            continue
        # too little of its own: as the nearest sure sentence before or after, of its script if it has one
        others = [j for j in [*range(i - 1, -1, -1), *range(i + 1, closing)] if sure[j]]
        same = [j for j in others if FAMILY.get(parts[j][5], parts[j][5]) == FAMILY.get(p[5], p[5])]
        enough = p[2] != "und" and p[4] >= LEAST_LETTERS / 2
        langs.append(parts[same[0]][2] if same else p[2] if enough or not others else parts[others[0]][2])
    out: list[list] = []
    for p, lang in zip(parts, langs):
        weight = max(p[4], 1)
        if out and out[-1][2] == lang:
            out[-1][1] = p[1]
        else:
            out.append([p[0], p[1], lang, 0.0, 0])
        if p[2] == lang:
            out[-1][3] += p[3] * weight
            out[-1][4] += weight
    return [(a, b, lang, round(c / n, 4) if n else 0.0) for a, b, lang, c, n in out]


def train(labelled: list[tuple[str, str]], rounds: int = 3) -> Profiles:
    """Profiles from (language, text) pairs, some of them wrong."""
    bare = [(lang, without_noise(t[a:b])) for lang, t in labelled for a, b in sentences(t)]
    texts = [(lang, own_words(t, s)) for lang, t in bare if (s := script_of(t)) == SCRIPT_OF[lang]]
    texts = [(lang, t) for lang, t in texts if sum(map(str.isalpha, t)) >= (5 if SCRIPT_OF[lang] in ("Han", "Kana") else 12)]
    weights = Counter(texts)
    profiles: Profiles = {}
    own = list(weights)
    for _ in range(rounds):
        counts: dict[str, Counter] = {}
        for lang, t in own:
            of = counts.setdefault(lang, Counter())
            # a text that many files share counts little more than one
            times = 1 + min(weights[(lang, t)], 16) ** 0.5
            for g, n in grams(t).items():
                of[g] += n * times
        profiles = {lang: {g: i for i, g in enumerate(ranked(c, PROFILE))} for lang, c in sorted(counts.items())}
        ranks = ranks_of(profiles)
        kept = [(lang, t) for lang, t in weights if lang in profiles and ranks[SCRIPT_OF[lang]].distances(t)[0][1] == lang]
        if set(kept) == set(own):
            break
        own = kept
    return profiles


def label_code() -> F.Column:
    """The language code of the column ``lang``, null if it says none that is known."""
    name = F.regexp_replace(F.lower(F.trim("lang")), r"[\s_]+", "-")
    return F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[name]


def trained_profiles(files: DataFrame, labels: DataFrame, most: int = TRAIN_FILES) -> Profiles:
    """Profiles trained on the labelled files of the smallest hashes, ``most`` of each label."""
    coded = labels.select("file_id", label_code().alias("code")).where("code IS NOT NULL").distinct()
    first = W.partitionBy("code").orderBy(F.xxhash64("file_id"), "file_id")  # ranked within tasks before the shuffle
    chosen = coded.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).drop("k")
    rows = files.select(F.col("id").alias("file_id"), F.col("content_snip").alias("text")).where("trim(content_snip) <> ''").join(F.broadcast(chosen), "file_id")
    return train(sorted((r.code, r.text) for r in rows.toLocalIterator()))


def _segmented(files: DataFrame, labels: DataFrame, fields: list[str]) -> DataFrame:
    """(id, codes, n_segments of the first field, field, seg_no, start, end, lang, confidence)."""
    profiles = trained_profiles(files, labels)
    sent = files.sparkSession.sparkContext.broadcast(ranks_of(profiles))
    codes = labels.groupBy("file_id").agg(F.collect_set(label_code()).alias("codes"))  # at most one of each language
    joined = files.select("id", *fields).join(codes.withColumnRenamed("file_id", "id"), "id", "left")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            out = []
            for row in zip(b["id"], b["codes"], *[b[f] for f in fields]):
                found = [segments(t, sent.value, known) for t in row[2:]]
                had = list(row[1]) if row[1] is not None else []
                main = found[0]
                state = "none" if not main else "mixed" if len({s[2] for s in main}) > 1 else "missing" if not had else "right" if had == [main[0][2]] else "wrong"
                out += [(row[0], state, f, i + 1, *s) for f, ss in zip(fields, found) for i, s in enumerate(ss)]
            yield pd.DataFrame(out, columns=["id", "state", "field", "seg_no", "start_pos", "end_pos", "lang", "confidence"])

    return joined.mapInPandas(scan, "id bigint, state string, field string, seg_no int, start_pos int, end_pos int, lang string, confidence double")


def language_segments(files: DataFrame, labels: DataFrame, fields: tuple[str, ...] = ("content_snip", "metadata_str")) -> DataFrame:
    """(id, state, field, seg_no, start_pos, end_pos, lang, confidence): every segment of every file.
    ``state`` tells of the first field: none (no text), mixed, or its label missing, wrong or right."""
    return _segmented(files, labels, list(fields))


def mended_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, field, seg_no, lang) of the files whose text is mixed, or its label missing or wrong."""
    return language_segments(files, labels).where(F.col("state").isin("mixed", "missing", "wrong")).select("id", "field", "seg_no", "lang")
