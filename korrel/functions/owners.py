"""Whose a file is, and who takes part in it, by its name and text.

An owner is a struct of tokens, role and confidence; lists of owners have at most ``V.NAME_CONFIDENCE["most"]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.functions import text as T
from korrel.functions import values as V
from korrel.functions.forms import is_name_like

LETTER = "A-Za-zऀ-ॿ"
SCORING = ["PRIMARY", "CO_PRIMARY"]
OWNERS = "array<struct<tokens:array<string>,role:string,confidence:double>>"
NO_NAMES = "array<string>"


def _run(most: int) -> str:
    """The pattern of a name, and what stands before it."""
    return rf"\s*[:\-]?\s*([{LETTER}][{LETTER}\s.'-]{{1,{most}}})"


def person_tokens(raw: Column) -> Column:
    """The name tokens of a text; null without any, or if all are words of documents."""
    tokens, words = T.only_name_letters(raw), T.words(V.DOCUMENT_WORDS)
    return F.when((F.size(tokens) > 0) & F.exists(tokens, lambda t: ~F.array_contains(words, t)), tokens)


def _owner(tokens: Column, role: str, confidence: float) -> Column:
    return F.struct(tokens.alias("tokens"), F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))


def _there(*owners: Column) -> Column:
    return F.filter(F.array(*owners), lambda o: o["tokens"].isNotNull())


def owners_in_name(stem: Column) -> Column:
    """The owners that a file name tells."""
    c, none, words = V.NAME_CONFIDENCE, F.array().cast(OWNERS), T.words(V.DOCUMENT_WORDS)
    parts = F.filter(F.split(stem, r"[_\-.\s]+"), lambda p: (F.length(p) >= 2) & ~F.array_contains(words, F.lower(p)) & ~F.lower(p).rlike(r"^(\d+|q[1-4])$") & is_name_like(p, []))
    first, second = person_tokens(F.get(parts, 0)), person_tokens(F.get(parts, 1))
    any_first = F.get(F.filter(F.transform(parts, lambda p: person_tokens(p)), lambda t: t.isNotNull()), 0)
    both = F.array(_owner(first, "CO_PRIMARY", c["two"]), _owner(second, "CO_PRIMARY", c["two"]))
    return (
        F.when(F.lower(stem).rlike("^(resume|cv)_"), _there(_owner(person_tokens(F.regexp_extract(stem, "^[^_]*_([^_]*)", 1)), "PRIMARY", c["resume"])))
        .when(F.size(parts) == 0, none).when(F.size(parts) == 1, _there(_owner(first, "PRIMARY", c["one"])))
        .when(first.isNotNull() & second.isNotNull(), both).otherwise(_there(_owner(any_first, "PRIMARY", c["first"])))
    )


def owners_in_text(text: Column) -> Column:
    """The owners that labels in a text announce, the first of each label."""
    names = [(role, sure, F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + label + _run(48), 1))) for role, sure, label in V.NAME_LABELS]
    return _there(*[_owner(person_tokens(name), role, sure) for role, sure, name in names])


def owners_of(stem: Column, text: Column, author: Column | None = None) -> Column:
    """The owners that a file's name, its text, and its author's entry tell, each tokens and role once,
    the surest first."""
    every = F.concat(owners_in_name(stem), owners_in_text(text))
    if author is not None:
        tokens = F.when(is_name_like(author, []), T.only_name_letters(author))
        wanted = (F.size(tokens) > 0) & ~F.exists(every, lambda o: o["role"] == "PRIMARY")
        every = F.when(wanted, F.concat(every, F.array(_owner(tokens, "PRIMARY", V.NAME_CONFIDENCE["author"])))).otherwise(every)
    once = F.aggregate(every, F.array().cast(OWNERS), lambda seen, o: F.when(F.exists(seen, lambda s: (s["role"] == o["role"]) & (s["tokens"] == o["tokens"])), seen).otherwise(F.concat(seen, F.array(o))))
    placed = F.transform(once, lambda o, i: F.struct((-o["confidence"]).alias("c"), i.alias("i"), o.alias("o")))
    return F.slice(F.transform(F.array_sort(placed), lambda p: p["o"]), 1, V.NAME_CONFIDENCE["most"])


def owners_of_json(text: Column) -> Column:
    """The owners stored as JSON: an unknown role is PRIMARY, a missing confidence one half; broken text has none."""
    roles = [*SCORING, "FATHER", "SPOUSE", "GUARDIAN", "NOMINEE", "WITNESS", "EMPLOYER"]
    read = F.coalesce(F.from_json(text, OWNERS), F.array().cast(OWNERS))
    return F.transform(
        F.filter(read, lambda o: o["tokens"].isNotNull()),
        lambda o: F.struct(o["tokens"].alias("tokens"), F.when(o["role"].isin(roles), o["role"]).otherwise("PRIMARY").alias("role"), F.coalesce(o["confidence"], F.lit(V.NAME_CONFIDENCE["unknown"])).alias("confidence")),
    )


def owners_to_json(owners: Column) -> Column:
    """Owners as JSON."""
    return F.to_json(F.slice(owners, 1, V.NAME_CONFIDENCE["most"]))


def owner_tokens(owners: Column, scoring: bool = True) -> Column:
    """The different tokens of those owners whose role counts, or of the others."""
    kept = F.filter(owners, lambda o: o["role"].isin(SCORING) if scoring else ~o["role"].isin(SCORING))
    return F.array_distinct(F.flatten(F.transform(kept, lambda o: o["tokens"])))


def surest(owners: Column) -> Column:
    """The highest confidence of the primary owners, 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.filter(owners, lambda o: o["role"] == "PRIMARY"), lambda o: o["confidence"])), F.lit(0.0))


def _party_names(raw: Column) -> Column:
    """The name tokens of a party, and its whole name if it has several."""
    tokens, stops = T.only_name_letters(F.trim(F.split(F.trim(raw), r"\s*(?:,|hereinafter|hereafter|\()")[0])), T.words(V.PARTY_WORDS)
    own = F.filter(tokens, lambda t: ~F.array_contains(stops, t) & is_name_like(t))
    whole = F.array_join(tokens, " ")
    both = F.concat(own, F.when((F.size(tokens) >= 2) & F.length(whole).between(3, 40), F.array(whole)).otherwise(F.array().cast(NO_NAMES)))
    return F.when(F.exists(tokens, lambda t: ~F.array_contains(stops, t)) & F.exists(tokens, lambda t: is_name_like(t)), both).otherwise(F.array().cast(NO_NAMES))


def parties_in_text(text: Column, most: int = V.PARTY_NAMES) -> Column:
    """The different names of those who sign a text, are its parties or are written to."""
    name = rf"([{LETTER}][{LETTER}\s.'-]{{1,48}})"
    between = rf"(?i)\bbetween\s+{name}\s+and\s+{name}"
    raws = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), group)
    pairs = F.flatten(F.transform(F.arrays_zip(raws(between, 1).alias("a"), raws(between, 2).alias("b")), lambda z: F.array(z["a"], z["b"])))
    said = F.concat(pairs, raws(rf"(?i)\bparty\s+[AB12]\s*[:\-]?\s*{name}", 1), raws(rf"(?i)\b(?:by|signed\s+by|signature\s+of)\s*[:\-]?\s*{name}", 1), raws(rf"(?i)\(([{LETTER}][{LETTER}\s.'-]{{1,40}})\)\s*(?:hereinafter|hereafter)", 1))
    mails = F.transform(F.filter(raws(rf"\b([{LETTER}][A-Za-z0-9ऀ-ॿ._-]{{1,30}})@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b", 1), lambda m: is_name_like(m)), lambda m: F.lower(m))
    names = F.concat(F.flatten(F.transform(said, lambda r: _party_names(r))), mails)
    return F.coalesce(F.slice(F.array_distinct(names), 1, most), F.array().cast(NO_NAMES))


def entities_of(text: Column, owners: Column) -> Column:
    """The parties of a text and the name-like tokens of the owners, each once."""
    tokens = F.transform(F.filter(F.flatten(F.transform(owners, lambda o: o["tokens"])), lambda t: is_name_like(t)), lambda t: F.lower(t))
    return F.array_distinct(F.concat(parties_in_text(text), tokens))


def without_entities(text: Column, entities: Column) -> Column:
    """A text without the words that are entities; the text itself if none is left."""
    kept = F.array_join(F.filter(F.split(text, r"\s+"), lambda w: (F.trim(w) != "") & ~F.array_contains(entities, F.lower(w))), " ")
    return F.when((F.size(entities) == 0) | (F.trim(kept) == ""), text).otherwise(kept)


def owns(owner: Column, target: Column) -> Column:
    """Whether an owner is the one that is asked for: by all tokens, or by one alike."""
    tokens = F.transform(owner["tokens"], lambda t: F.lower(t))
    every = F.forall(target, lambda t: F.array_contains(tokens, t))
    some = F.exists(target, lambda t: F.exists(tokens, lambda e: T.glued_match(e, t)) | T.contains_token(F.array_join(tokens, " "), t))
    return (F.size(target) > 0) & (F.size(tokens) > 0) & (every | some)


def owner_factor(owners: Column, confidence: Column, target: Column) -> Column:
    """How well a file's owners fit those that a query asks for; 1 if it asks for none."""
    f, scoring = V.OWNER_FACTORS, F.filter(owners, lambda o: o["role"].isin(SCORING))
    ours = F.exists(scoring, lambda o: owns(o, target))
    beside = F.exists(owners, lambda o: ~o["role"].isin(SCORING) & owns(o, target))
    sure = F.exists(scoring, lambda o: (F.size(o["tokens"]) > 0) & ((o["confidence"] >= f["confident"]) | (confidence >= f["confident"])))
    return F.when((F.size(target) <= 0) | (F.size(owners) <= 0), 1.0).when(ours, f["primary"]).when(beside, 1.0).when(sure, f["other_owner"]).otherwise(1.0)
