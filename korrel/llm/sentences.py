"""Sentence units of texts in many languages and layouts.

A text is cut into blocks: at blank lines, and before list items and chat lines. Within a block
every end mark, every closing quote or bracket after an end mark, and in scripts that end sentences
by a blank every blank, is a candidate. A maximum-entropy model (logistic regression over the
neighbouring words, case, length, digits, script, the mark, and how often the words end and start
blocks in the corpus) decides on each. Text in quotes or brackets holds no candidates.

The model is trained on *reliable* candidates only: ends of paragraphs, strong marks before a
capital, and marks before a small letter or after a title, on the documents of the smallest hashes
(``TRAIN_DOCS``). The counts of words at block starts and ends are taken over all documents, in a
sketch of fixed size; what is said of a word counts from EVIDENCE uses on, however large the corpus.

Defined results: null, empty and blank texts have no units; a paragraph without end marks is one
unit; a mark or bracket without its partner is an ordinary character; units never overlap and hold
every non-blank character of the text; repeated documents give the same units under their own ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most documents the model is trained on.
TRAIN_DOCS = 4000
#: Uses of a word from which its counts are believed: among so few, a word that may end a block with a
#: chance of one in five is never seen to do so once in a hundred times.
EVIDENCE = 20
#: Rows and slots of the sketch of counts: a word counts in one slot of each row, the least is taken. All
#: words share the slots, so rare words are overrated by the mean of a slot: of a corpus with a million
#: words of one use each, by 4 uses.
ROWS, SLOTS = 2, 1 << 18

# Abbreviations that stand before what they belong to, and those that may end a sentence.
BEFORE = set(
    """dr prof rev mr mrs ms st messrs vs no nos fig figs sec p pp vol app cf incl approx i.e e.g dept art nr abs ca
    inkl fa hr hrn fr frl z d h bzw evtl str m mm mme mlle env éts ets c.-à-d cie sr sra srta dra pág pag núm num aprox
    cía cia ej ee gen col capt sgt hon u.a vgl s kap bd abb tab ed eds ch al.dr डॉ श्री श्रीमती पृ क्र सं के ए एम எண் ஆர் பக் டாக்டர்
    திரு திருமதி நபி นพ พญ ดร น.ส ด.ช สพ""".split()
)
MAY_END = set("etc al a.m p.m jr co inc ltd uhr usw ff uu u.s u.k corp bros esq".split())

MARKS = ".!?…。！？।॥|؟।"
STRONG = "!?。！？।॥؟"
CJK_MARKS = "。！？"
OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›"}
CLOSERS = "\"”“»›」』）)]}】》’'"
LIST_MARK = regex.compile(r"(?:[-•*–·▪◦‣]|(\d{1,3})[.)]|\([a-z\d]{1,2}\))[ \t]+(?=\S)")
CHAT_MARK = regex.compile(r"(?:\[?\d{1,4}[/.\-]\d{1,2}(?:[/.\-]\d{1,4})?,?[ T]\d{1,2}:\d{2}(?::\d{2})?\]?|\[\d{1,2}:\d{2}(?::\d{2})?\])\s*(?:-\s)?[^\n:]{1,40}: ")
BLANK_LINE = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
RUN = regex.compile(r"[.!?…。！？।॥|؟]+")
DEVANAGARI, THAI = regex.compile(r"\p{Devanagari}"), regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
FILE = regex.compile(r"^[A-Za-z\d][\w\-.()]*\.[a-z][a-z\d]{1,4}\b")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
LETTER, DIGITS, STOP, BLANKS = regex.compile(r"\p{L}"), regex.compile(r"\d+"), regex.compile(r"\."), regex.compile(r"\s+")
PAIRED = regex.compile(r"[\"“”„«»‹›「」『』()（）\[\]{}【】《》]")
#: Repetition mark that stands after a blank but belongs to the word before.
THAI_REPEAT = "ๆ"


@dataclass
class Block:
    """A stretch of text that no sentence leaves. ``kind`` is text, item or chat."""

    start: int
    end: int
    kind: str
    body: int  # where its text begins, after a list mark or a sender
    ends_paragraph: bool = False


@dataclass
class Candidate:
    """A place where a sentence may end: at ``end`` (exclusive)."""

    end: int
    at: int
    kind: str
    opened: int = -1


def slots_of(word: str) -> list[int]:
    """The slot of a word in each row of the sketch."""
    h = xxhash.xxh64_intdigest(word)
    return [h >> 20 * r & SLOTS - 1 for r in range(ROWS)]


class Counts:
    """How often words start blocks, and how often what stands before an end mark ends one."""

    def __init__(self, cells: Iterable[tuple[str, int, int, int, int]] = ()) -> None:
        """``cells``: (start or end, row, slot, uses, of these at the end of a block)."""
        self.uses = {"start": np.zeros((ROWS, SLOTS), dtype=np.int64), "end": np.zeros((ROWS, SLOTS), dtype=np.int64)}
        self.last = np.zeros((ROWS, SLOTS), dtype=np.int64)
        for what, row, slot, n, last in cells:
            self.uses[what][row, slot] += n
            if what == "end":
                self.last[row, slot] += last
        self.total = max(int(self.uses["start"][0].sum()), 1)
        self.held: dict[tuple[str, str], float | None] = {}

    def share(self, what: str, word: str) -> float | None:
        """Of all block starts the share of a word, or the share of a word's marks that end a block; None
        for words of fewer than EVIDENCE uses. What was found is kept for up to 200,000 words."""
        key = (what, word)
        if key not in self.held:
            if len(self.held) >= 200_000:
                self.held.clear()
            places = list(enumerate(slots_of(word)))
            n, (r, k) = min((int(self.uses[what][r, k]), (r, k)) for r, k in places)
            self.held[key] = None if n < EVIDENCE else n / self.total if what == "start" else int(self.last[r, k]) / n
        return self.held[key]


def cells_of(seen: dict[tuple[str, str, bool], int]) -> list[tuple[str, int, int, int, int]]:
    """The cells of ``Counts`` from {(start or end, word, at the end of a block): uses}."""
    out: dict[tuple[str, int, int], list[int]] = {}
    for (what, word, last), n in seen.items():
        for r, k in enumerate(slots_of(word)):
            cell = out.setdefault((what, r, k), [0, 0])
            cell[0] += n
            cell[1] += n * last
    return [(*key, n, last) for key, (n, last) in out.items()]


def count_text(text: str | None, seen: dict[tuple[str, str, bool], int]) -> None:
    """Count the words at the block starts and before the end marks of a text."""
    for block in blocks(text or ""):
        if block.kind == "text":
            key = ("start", first_key(word_after(text, block.start, block.end)), True)
            seen[key] = seen.get(key, 0) + 1
        for m in STOP.finditer(text, block.start, block.end):
            if m.end() == block.end or text[m.end()].isspace():
                key = ("end", last_key(word_before(text, m.start(), block.start)[0]), m.end() == block.end)
                seen[key] = seen.get(key, 0) + 1


def blocks(text: str) -> list[Block]:
    """The blocks of a text, in order, without blanks around them."""
    out: list[Block] = []
    at = 0
    cuts = [(m.start(), m.end()) for m in BLANK_LINE.finditer(text)] + [(len(text), len(text))]
    for end, after in cuts:
        start, kind, number, first, own = at, "text", 0, True, at
        line = at
        while line < end:
            stop = text.find("\n", line, end)
            stop = end if stop < 0 else stop
            body = line
            while body < stop and text[body].isspace():
                body += 1
            item = LIST_MARK.match(text, body, stop)
            found, mark_end = "", body
            if item:
                n = int(item.group(1)) if item.group(1) else 0
                # a wrapped line may start with an ordinal: numbers must count on
                if not item.group(1) or n == number + 1 or (first and n):
                    found, number, mark_end = "item", n or number, item.end()
            if not found and (chat := CHAT_MARK.match(text, body, stop)):
                found, mark_end = "chat", chat.end()
            if found:
                _add(out, text, start, line, kind, own)
                start, kind, own = body, found, mark_end
            first = False
            line = stop + 1
        _add(out, text, start, end, kind, own)
        if out:
            out[-1].ends_paragraph = True
        at = after
    return out


def _add(out: list[Block], text: str, start: int, end: int, kind: str, body: int) -> None:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    if start < end:
        out.append(Block(start, end, kind, min(max(start, body), end)))


def spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(opening, closing) of the outermost quotes and brackets of a block; lone ones are left out."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    straight = -1
    for m in PAIRED.finditer(text, start, end):
        i, c = m.start(), m.group()
        if c == '"':
            if straight < 0:
                straight = i
            else:
                pairs.append((straight, i))
                straight = -1
        elif c in "“”»" and (k := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), -1)) >= 0:
            pairs.append((stack[k][1], i))
            del stack[k:]
        elif c in OPEN:
            stack.append((OPEN[c], i))
        elif c in ")]}」』）】》›" and (k := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), -1)) >= 0:
            pairs.append((stack[k][1], i))
            del stack[k:]
    outer: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def candidates(text: str, block: Block) -> list[Candidate]:
    """The places in a block where a sentence may end, in order; the end of the block is none."""
    inner = spans(text, block.body, block.end) if any(c in text[block.body : block.end] for c in "\"“„«「『（([{【《") else []
    hindi = "|" in text[block.start : block.end] and DEVANAGARI.search(text, block.start, block.end) is not None
    out: list[Candidate] = []
    free = block.body
    for a, b in [*inner, (block.end, block.end)]:
        for m in RUN.finditer(text, free, a):
            run = m.group()
            if "|" in run and not hindi:
                continue
            end = m.end()
            while end < a and text[end] in CLOSERS:
                end += 1
            if end >= block.end:
                continue
            if text[end].isspace() or run[-1] in CJK_MARKS:
                out.append(Candidate(end, m.start(), "mark"))
        if b < block.end:
            last = b - 1
            while last > a and (text[last].isspace() or text[last] in CLOSERS):
                last -= 1
            if text[last] in MARKS and b + 1 < block.end and (text[b + 1].isspace() or CJK.match(text[b + 1])):
                out.append(Candidate(b + 1, last, "close", a))
        free = b + 1
    if THAI.search(text, block.body, block.end):
        held = {c.end for c in out}
        for m in BLANKS.finditer(text, block.body, block.end):
            i, j = m.start(), m.end()
            if i in held or any(a < i < b for a, b in inner) or text[j] == THAI_REPEAT:
                continue
            before = text[i - 2] if text[i - 1] == THAI_REPEAT and i - 2 > block.body else text[i - 1]
            if THAI.match(before) or THAI.match(text[j]) or text[i - 1] == THAI_REPEAT:
                if not (text[i - 1] in MARKS and text[i - 1] != THAI_REPEAT):
                    out.append(Candidate(i, i, "blank", next((a for a, b in inner if b == i - 1), -1)))
        out.sort(key=lambda c: c.end)
    return out


def word_before(text: str, at: int, least: int) -> tuple[str, int]:
    """The word that ends at ``at``, without opening marks, and where it starts."""
    i = at
    while i > least and not text[i - 1].isspace():
        i -= 1
    j = i
    while j < at and text[j] in "\"'“„«»(（[「『‘’—":
        j += 1
    return text[j:at], i


def word_after(text: str, at: int, end: int) -> str:
    """The next word (of scripts without blanks, its first characters)."""
    while at < end and text[at].isspace():
        at += 1
    j = at
    while j < end and not text[j].isspace() and j - at < 24:
        j += 1
    return text[at:j]


@lru_cache(1 << 16)
def first_key(word: str) -> str:
    """By what a word's block starts are counted: Latin words whole, others by their first characters."""
    word = word.lstrip("\"'“„«»(（[「『‘’—¿¡").lower()
    if not word:
        return ""
    if CJK.match(word):
        return word[:2]
    if THAI.match(word):
        return word[:5]
    return DIGITS.sub("0", word.rstrip(".,;:!?।”\"»)"))[:12]


@lru_cache(1 << 16)
def last_key(word: str) -> str:
    """By what a word's block ends are counted."""
    return DIGITS.sub("0", word.lower())[-12:]


@lru_cache(1 << 16)
def shape(word: str) -> str:
    """The class of a word by its first character."""
    if not word:
        return "none"
    c = word[0]
    if FILE.search(word):
        return "file"
    if c in "\"“„«「『‹¿¡":
        return "quote"
    if c in "([{（【《":
        return "bracket"
    if c in "—–-":
        return "lower" if word[1:2].islower() else "dash"
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    if THAI.match(c):
        return "thai"
    if CJK.match(c):
        return "cjk"
    return "other" if c.isalpha() else "sign"


def level(share: float | None) -> str:
    """A share in five steps."""
    return "none" if not share else "0" if share < 0.002 else "1" if share < 0.02 else "2" if share < 0.1 else "3"


@lru_cache(1 << 16)
def ending(word: str) -> tuple[str, str]:
    """(abbreviation, kind) of a word before a mark."""
    k = word.lower()
    bare = k.rstrip(".")
    abbreviation = "may" if bare in MAY_END else "before" if bare in BEFORE else "no"
    if k[:1].isdigit() and not LETTER.search(k):
        return abbreviation, "digit"
    if len(bare) == 1:
        return abbreviation, "one"
    if "." in bare:
        return abbreviation, "dotted" if len(bare) <= 8 and not DIGITS.search(bare) else "file"
    return abbreviation, "thai" if THAI.search(word[-1:]) else "short" if len(bare) <= 3 else "long"


def facts(text: str, c: Candidate, unit: int, following: str, counts: Counts) -> tuple[str, ...]:
    """What the features of a candidate are made of, in a unit that starts at ``unit``, with the word
    that follows. Each fact is one of a few."""
    w1, at1 = word_before(text, c.at, unit)
    w2 = word_before(text, at1 - 1, unit)[0] if at1 - 1 > unit else ""
    mark = text[c.at : c.end].strip(CLOSERS)[:1] if c.kind != "blank" else "_"
    long_mark = c.kind == "mark" and c.end - c.at > 1 and mark in ".…"
    abbreviation, kind1 = ending(w1)
    second = "abbr" if w2.endswith(".") and w2.lower().rstrip(".") in BEFORE else "start" if not w2 else "word"
    share = counts.share("end", last_key(w1))
    lead = ""
    if c.opened >= 0:
        before = text[unit : c.opened].rstrip()
        lead = "none" if not before else "colon" if before[-1] in ":：,，،" else "cjk" if CJK.match(before[-1]) else "word"
    return (
        f"{mark}{long_mark}", c.kind, abbreviation if mark in "." else "-", kind1, second, shape(following), level(counts.share("start", first_key(following))),
        f"{level(share) if mark == '.' else '-'}{'u' if share is None else 'k'}", lead,
    )


def features(own: tuple[str, ...]) -> list[str]:
    """The features of a candidate: its facts, and some of them together."""
    mark, kind, abbreviation, kind1, second, s2, starts, ends, lead = own
    out = [
        "bias", f"mark={mark}", f"kind={kind}", f"abbr={abbreviation}", f"k1={kind1}", f"s2={s2}", f"starts={starts}", f"ends={ends}",
        f"abbr,s2={abbreviation},{s2}", f"k1,s2={kind1},{s2}", f"k1,second,s2={kind1},{second},{s2}", f"k1,starts={kind1},{starts}",
        f"mark,s2={mark},{s2}", f"kind,starts,s2={kind},{starts},{s2}", f"k1,ends={kind1},{ends}",
    ]
    return out + ([f"lead={lead}", f"lead,s2={lead},{s2}"] if lead else [])


def label(text: str, c: Candidate, unit: int, following: str, counts: Counts) -> int | None:
    """1 or 0 if a candidate within a block is reliably an end or none, else None."""
    w1, at1 = word_before(text, c.at, unit)
    s2, bare = shape(following), w1.lower().rstrip(".")
    mark = text[c.at : c.at + 1]
    if s2 == "lower":
        return 0
    if c.kind == "close":
        before = text[unit : c.opened].rstrip()
        if before and before[-1] in ":：,，،":
            return 1
        if s2 == "cjk":
            return 0
        return None
    if c.kind == "blank":
        if text[c.at - 1].isdigit() and s2 == "thai" or s2 in ("digit", "file"):
            return 0
        return None
    if mark == "." and bare in BEFORE:
        return 0
    if mark in "…" and s2 == "cjk":
        return 0
    if mark == "." and len(bare) == 1 and bare.isalpha() and s2 == "upper" and not (at1 - 1 > unit and word_before(text, at1 - 1, unit)[0].lower().rstrip(".") in BEFORE):
        return 0
    if mark == "." and len(bare) >= 5 and LETTERS.fullmatch(bare) and s2 in ("upper", "file", "other") and bare not in MAY_END and counts.share("end", last_key(w1)) != 0:
        return 1  # a long word that isn't one that never ends a block
    if mark in STRONG and s2 in ("upper", "other", "cjk", "thai", "file"):
        return 1
    return None


def units(text: str | None, weights: dict[str, float], counts: Counts, known: dict[tuple[str, ...], bool] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text. ``known`` keeps what was decided on equal facts."""
    known = {} if known is None else known
    if not text or not text.strip():
        return []
    out = []
    for block in blocks(text):
        unit = block.start
        for c in candidates(text, block):
            following = word_after(text, c.end, block.end)
            if not following or c.end <= unit:
                continue
            own = facts(text, c, max(unit, block.body), following, counts)
            if own not in known:
                known[own] = sum(weights.get(f, 0.0) for f in features(own)) > 0
            if known[own]:
                out.append((unit, c.end))
                unit = c.end
                while text[unit].isspace():
                    unit += 1
        out.append((unit, block.end))
    return out


def examples(text: str | None, counts: Counts) -> Iterator[tuple[list[str], int]]:
    """(features, label) of the reliable candidates of a text."""
    if not text:
        return
    bs = blocks(text)
    for k, block in enumerate(bs):
        unit = block.body
        for c in candidates(text, block):
            following = word_after(text, c.end, block.end)
            if not following or c.end <= unit:
                continue
            y = label(text, c, unit, following, counts)
            if y is not None:
                yield features(facts(text, c, unit, following, counts)), y
            if y == 1:
                unit = c.end
                while text[unit].isspace():
                    unit += 1
        if block.ends_paragraph and block.kind == "text" and k + 1 < len(bs) and bs[k + 1].kind == "text":
            following = word_after(text, bs[k + 1].start, bs[k + 1].end)
            end = block.end
            at = end
            while at > unit and text[at - 1] in MARKS:
                at -= 1
            if at < end and not (text[at - 1] in CLOSERS):
                yield features(facts(text, Candidate(end, at, "mark"), unit, following, counts)), 1
            elif at == end and THAI.match(text[end - 1]):
                yield features(facts(text, Candidate(end, end, "blank"), unit, following, counts)), 1


def fit(data: list[tuple[list[str], int]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> dict[str, float]:
    """Maximum-entropy weights by full-batch gradient steps with adaptive rates; both classes weigh
    the same in all."""
    if not data:
        return {}
    index: dict[str, int] = {}
    width = max(len(fs) for fs, _ in data)
    x = np.zeros((len(data), width), dtype=np.int32)
    for i, (fs, _) in enumerate(data):
        for j, f in enumerate(fs):
            x[i, j] = index.setdefault(f, len(index) + 1)
    y = np.array([y for _, y in data], dtype=np.float64)
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(len(index) + 1)
    seen = np.full(len(index) + 1, 1e-8)
    flat = x.ravel()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(flat, weights=np.repeat(each * (p - y), width), minlength=len(w)) + l2 * w
        g[0] = 0
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return {f: float(w[i]) for f, i in index.items()}


def count_words(documents: DataFrame) -> Counts:
    """Words at block starts and before end marks, over all documents."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple[str, str, bool], int] = {}
            for text in b["text"]:
                count_text(text, seen)
            yield pd.DataFrame(cells_of(seen), columns=["what", "row", "slot", "n", "last"])

    counted = documents.select("text").mapInPandas(scan, "what string, row int, slot int, n bigint, last bigint")
    cells = counted.groupBy("what", "row", "slot").agg(F.sum("n").alias("n"), F.sum("last").alias("last")).toArrow()  # at most 2 * ROWS * SLOTS rows
    return Counts(zip(*[cells[c].to_pylist() for c in ("what", "row", "slot", "n", "last")]))


def train(documents: DataFrame, counts: Counts, most: int = TRAIN_DOCS) -> dict[str, float]:
    """Weights fitted on the documents of the smallest hashes, at most ``most``."""
    sample = documents.where("text IS NOT NULL").select("text", F.xxhash64("doc_id", F.length("text")).alias("h")).orderBy("h").limit(most)
    data = [e for r in sample.toLocalIterator() for e in examples(r.text, counts)]
    return fit(data)


def sentence_units(documents: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, start_pos, end_pos): the sentence units of every document."""
    counts = count_words(documents)
    weights = train(documents, counts, most)
    counts.held.clear()
    sent = documents.sparkSession.sparkContext.broadcast((weights, counts))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, counts = sent.value
        known: dict[tuple[str, ...], bool] = {}
        for b in batches:
            yield pd.DataFrame([(d, *u) for d, t in zip(b["doc_id"], b["text"]) for u in units(t, weights, counts, known)], columns=["doc_id", "start_pos", "end_pos"])

    return documents.select("doc_id", "text").mapInPandas(scan, "doc_id bigint, start_pos int, end_pos int")
