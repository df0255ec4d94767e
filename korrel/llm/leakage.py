"""Evaluation texts that stand in a corpus, wholly or partly.

One Aho-Corasick automaton holds the items, cut into blocks of ``(least + 1) // 2`` words: whatever
run of ``least`` words a text shares with an item, one whole block of the item lies within it. So the
automaton has about one node for each word of the items. Its alphabet are the items' own words: a
text is turned into numbers of known words (0 for all others) and scanned once; every block found is
extended word by word to both sides, and the ends lead back to the places in the text as it was.

Words are what stands between blanks or line breaks, case-folded and composed, without punctuation,
symbols and markup around them; what is only punctuation is no word.

Defined results: null and empty texts hold nothing; items of fewer than ``least`` words are held by
no text; items with equal text are all reported; repeated documents are each reported; of passages of
one item that lie within each other only the longest is reported.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.session import cut

#: Words of items in one automaton, about (one item is never divided). More items are scanned for in
#: several passes, one after the other, so that only one such group is held at any time. Measured are
#: 153 bytes a word in each Python worker, so about 230 MB for a group.
GROUP_WORDS = 1_500_000

_AROUND = regex.compile(r"^[\p{P}\p{S}\p{Z}\p{C}]+|[\p{P}\p{S}\p{Z}\p{C}]+$")
_WORD = regex.compile(r"\S+")


def word(raw: str) -> str:
    """``raw`` as it is compared; empty if nothing but punctuation."""
    if raw.isascii() and raw.isalnum():
        return raw.lower()
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", raw).casefold())
    return folded if folded.isalnum() else _AROUND.sub("", folded)


class Matcher:
    """The automaton of a group of items."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least, self.block = least, (least + 1) // 2
        self.numbers: dict[str, int] = {}
        self.raw: dict[str, int] = {}
        self.ids: list[int] = []
        self.texts: list[list[int]] = []
        self.automaton = None
        starts: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item_id, text in items:
            known = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in map(word, (text or "").split()) if w]
            if len(known) < least:
                continue
            for i in range(0, len(known) - self.block + 1, self.block):
                starts.setdefault(tuple(known[i : i + self.block]), []).append((len(self.ids), i))
            self.ids.append(item_id)
            self.texts.append(known)
        if starts:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for block, places in starts.items():
                self.automaton.add_word(block, places)
            self.automaton.make_automaton()

    def number(self, raw: str) -> int:
        """The number of a word as it stands in a text: 0 if no item has it, -1 if it is no word."""
        known = self.raw.get(raw)
        if known is None:
            w = word(raw)
            known = self.numbers.get(w, 0) if w else -1
            if len(self.raw) < 1_000_000:
                self.raw[raw] = known
        return known

    def passages(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words) of the longest passages that ``text`` shares with each item."""
        if not text or self.automaton is None:
            return []
        numbers = tuple(x for x in map(self.number, text.split()) if x >= 0)
        if len(numbers) < self.least or not any(numbers):
            return []
        found: dict[int, set[tuple[int, int]]] = {}
        seen: dict[tuple[int, int], int] = {}  # how far (item, shift) has been compared
        for end, places in self.automaton.iter(numbers):
            first = end - self.block + 1
            for k, at in places:
                if seen.get((k, first - at), -1) >= end:
                    continue
                own = self.texts[k]
                a, i, b, j = first, at, end + 1, at + self.block
                while a and i and numbers[a - 1] == own[i - 1]:
                    a, i = a - 1, i - 1
                while b < len(numbers) and j < len(own) and numbers[b] == own[j]:
                    b, j = b + 1, j + 1
                seen[k, first - at] = b - 1
                if b - a >= self.least:
                    found.setdefault(self.ids[k], set()).add((a, b))
        if not found:
            return []
        places = [(m.start(), m.end()) for m in _WORD.finditer(text) if self.number(m.group()) >= 0]
        out = []
        for item, runs in sorted(found.items()):
            last = -1
            for a, b in sorted(runs, key=lambda x: (x[0], -x[1])):
                if b > last:  # else within one that began before
                    out.append((item, places[a][0], places[b - 1][1], b - a))
                    last = b
        return out


#: The automaton that this Python worker used last.
_held: dict[tuple[str, int], Matcher] = {}


def _matcher(key: tuple[str, int], items: list[tuple[int, str]], least: int) -> Matcher:
    """The automaton of a group, made once for each Python worker."""
    if key not in _held:
        _held.clear()
        _held[key] = Matcher(items, least)
    return _held[key]


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id, start_pos, end_pos, n_words): every longest passage of ``least`` words or
    more that a document shares with an item, with its place in the document's text."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    schema = "doc_id bigint, item_id bigint, start_pos int, end_pos int, n_words int"
    words = F.size(F.split(F.trim("text"), r"\s+"))
    usable = items.where(words >= least)
    total = usable.agg(F.sum(words).alias("n")).collect()[0].n or 0
    groups = max(1, math.ceil(total / GROUP_WORDS))
    out = None
    for g in range(groups):
        own = usable if groups == 1 else usable.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        rows = own.select("item_id", "text").toArrow()
        sent = spark.sparkContext.broadcast(sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())))
        name = uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame], sent=sent, name=name) -> Iterator[pd.DataFrame]:
            matcher = _matcher((name, least), sent.value, least)
            for b in batches:
                yield pd.DataFrame([(d, *p) for d, t in zip(b["doc_id"], b["text"]) for p in matcher.passages(t)], columns=["doc_id", "item_id", "start_pos", "end_pos", "n_words"])

        found = texts.mapInPandas(scan, schema)
        if groups > 1:  # written before the next group is sent
            found = cut(found)
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id), distinct: the items that each document holds. A document's passages come
    from one task, so the pairs are made distinct before any shuffle."""
    return leaked_passages(documents, items, least).select("doc_id", "item_id").distinct()
