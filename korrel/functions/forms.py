"""What a query says: its language, clean words, aliases, synonyms, categories, and whose files it asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.functions import text as T
from korrel.functions import values as V

#: Words that a query is cleaned of, where no other list is given.
STOPS = [w for w in V.FILLERS if w not in V.POSSESSIVES]
#: Words of a clean query, at most.
CLEAN_WORDS = 10

ALIASES = {form: [x for x in group if len(x) > 1] for group in V.ALIAS_GROUPS for form in group}


def asked_language(query: Column, phrases: dict[str, list[str]] = V.LANGUAGE_PHRASES) -> Column:
    """(hint, stripped): the language that a query asks for, the last one of several, and the query
    without the phrases that say so."""
    every = F.expr("array(" + ", ".join(f"named_struct('lang', {T.quoted(lang)}, 'phrase', {T.quoted(p)})" for lang, ps in phrases.items() for p in sorted(ps, key=len, reverse=True)) + ")")
    start = F.struct(F.lower(query).alias("text"), F.lit(None).cast("string").alias("hint"))
    found = F.aggregate(every, start, lambda a, p: F.when(a["text"].contains(p["phrase"]), F.struct(F.replace(a["text"], p["phrase"], F.lit(" ")).alias("text"), p["lang"].alias("hint"))).otherwise(a))
    return F.transform(F.array(found), lambda a: F.struct(a["hint"].alias("hint"), F.trim(F.regexp_replace(a["text"], r"\s+", " ")).alias("stripped")))[0]


def everyday(text: Column, words: dict[str, str] = V.COLLOQUIAL) -> Column:
    """A text with everyday words of other languages in English, and no marks around words."""
    known = T.lookup_map(words)
    bare = F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(".,?!\"'"))), lambda w: F.trim(w) != "")
    return F.array_join(F.transform(bare, lambda w: F.coalesce(known[w], w)), " ")


def without_stops(text: Column, stops: list[str] = STOPS) -> Column:
    """A text without stop words and single characters."""
    return F.array_join(T.without_stop_words(F.split(F.lower(text), r"\s+"), stops), " ")


def core_of(text: Column, stops: list[str] = STOPS) -> Column:
    """The tokens of a text that are no stop words."""
    none = T.words(stops)
    return F.filter(T.tokenize(text), lambda t: ~F.array_contains(none, t))


def _first_words(text: Column) -> Column:
    return F.array_join(F.slice(T.tokenize(text), 1, CLEAN_WORDS), " ")


def or_else(text: Column, other: Column) -> Column:
    """``text``, or ``other`` where it is blank."""
    return F.when(F.trim(text) != "", text).otherwise(other)


def embed_text(stripped: Column, stops: list[str] = STOPS) -> Column:
    """The clean words of a query without language phrases."""
    return or_else(_first_words(without_stops(everyday(stripped), stops)), _first_words(stripped))


def clean_query(text: Column, stops: list[str] = STOPS) -> Column:
    """At most CLEAN_WORDS clean words; without any, the text in small letters."""
    return or_else(_first_words(without_stops(everyday(text), stops)), F.lower(F.trim(text)))


def spoken(text: Column, stops: list[str] = STOPS) -> Column:
    """A spoken query as it is shown: cleaned, with the phrase of its language at the end."""
    plain = F.trim(F.regexp_replace(F.trim(text), r"\s+", " "))
    return F.transform(F.array(asked_language(plain)), lambda a: F.concat_ws(" ", or_else(without_stops(everyday(a["stripped"]), stops), or_else(a["stripped"], plain)), T.lookup_map(V.LANGUAGE_PHRASE)[a["hint"]]))[0]


def aliases_of(tokens: Column) -> Column:
    """Tokens of more than one character with all words of their meaning."""
    return F.filter(T.expanded(tokens, ALIASES), lambda t: F.length(t) > 1)


def with_synonyms(text: Column) -> Column:
    """A text followed by what its words stand for, in the order of the list."""
    tokens = T.tokenize(text)
    every = F.expr("array(" + ", ".join(f"named_struct('word', {T.quoted(w)}, 'more', {T.quoted(more)})" for w, more in V.SYNONYMS.items()) + ")")
    return F.array_join(F.concat(F.array(text), F.transform(F.filter(every, lambda e: F.array_contains(tokens, e["word"])), lambda e: e["more"])), " ")


def hits_of(text: Column, tokens: Column, signals: list[str]) -> Column:
    """How many of the signals a text holds: words among its tokens, phrases anywhere."""
    phrases, single = [s for s in signals if " " in s], [s for s in signals if " " not in s]
    found = F.size(F.array_intersect(T.words(single), tokens))
    for p in phrases:
        found = found + text.contains(p).cast("int")
    return found


def two_best(scores: list[tuple[str, Column, Column]]) -> Column:
    """The names of the two highest positive scores of (name, score, order), the least order first of equal ones."""
    ranked = F.array(*[F.struct((-score).alias("score"), order.alias("order"), F.lit(name).alias("name")) for name, score, order in scores])
    return F.transform(F.slice(F.array_sort(F.filter(ranked, lambda s: s["score"] < 0)), 1, 2), lambda s: s["name"])


def asked_categories(query: Column) -> Column:
    """The two categories that a query points to most."""
    low, tokens = F.lower(query), T.tokenize(query)
    return two_best([(name, hits_of(low, tokens, signals), F.lit(i)) for i, (name, signals) in enumerate(V.CATEGORY_SIGNALS.items())])


SIGNAL_WORDS = list(dict.fromkeys(w for signals in V.CATEGORY_SIGNALS.values() for s in signals for w in s.split()))


def asked_type(query: Column, clean: Column) -> Column:
    """The kind of file that a query asks for. Words for any file count only in queries of one word."""
    low, n, out = F.lower(query), F.size(F.filter(F.split(clean, r"\s+"), lambda t: F.trim(t) != "")), None
    for name, triggers in V.TYPE_HINTS:
        sure = [t for t in triggers.split() if t not in ("file", "document", "doc")]
        found = low.rlike(rf"\b(?:{'|'.join(sure)})\b")
        if len(sure) < len(triggers.split()):
            found = found | (n < 2) & low.rlike(rf"\b(?:{'|'.join(triggers.split())})\b")
        out = F.when(found, F.lit(name)) if out is None else out.when(found, F.lit(name))
    return out


def letters_in(text: Column) -> Column:
    """The number of letters and Devanagari signs of a text."""
    return F.length(F.regexp_replace(text, r"[^\p{L}ऀ-ॿ]", ""))


def is_name_like(text: Column, but: list[str] = V.PARTY_WORDS) -> Column:
    """Whether a text may be a name: 2 to 50 characters, half of them letters, no number, none of ``but``."""
    t = F.trim(text)
    return F.length(t).between(2, 50) & ~t.rlike(r"^\d+$") & ~F.lower(t).isin(but or [""]) & (letters_in(t) >= F.floor(F.length(t) / 2))


def asks_for_person(tokens: Column) -> Column:
    """Whether the core tokens of a query are a person's name: one or two, name-like, no word of documents."""
    kept = F.filter(tokens, lambda t: F.length(t) >= 2)
    signals = T.words(SIGNAL_WORDS)
    return F.size(kept).between(1, 2) & ~F.exists(kept, lambda t: F.array_contains(signals, F.lower(t))) & F.forall(kept, lambda t: is_name_like(t))


def says_whose(query: Column) -> Column:
    """Whether a query has a word for its asker's own."""
    return F.lower(query).rlike(rf"\b(?:{'|'.join(V.POSSESSIVES)})\b")


def named_owner(query: Column, own_name: list[str], by_words: bool = True) -> Column:
    """The name tokens of another person whose files a query asks for: NAME's, for NAME, of NAME, or up to
    three words beside one for an identity document; empty if none. With ``by_words`` such a
    document must be a word of the query, else it may stand within one."""
    letter = "A-Za-zऀ-ॿ"
    low, tokens = F.lower(query), T.tokenize(query)
    possessor = T.only_name_letters(F.regexp_extract(query, rf"(?i)\b([{letter}][{letter}\s.'-]{{1,30}})'s\b", 1))
    own = F.array_sort(F.array_distinct(T.words(own_name))) if own_name else None
    is_self = F.lit(False) if own is None else says_whose(query) & (F.array_sort(possessor) == own)
    after = F.regexp_extract(query, rf"(?i)\b(?:for|of)\s+([{letter}][{letter}\s.'-]{{1,40}})", 1)
    receiver = T.only_name_letters(F.split(F.trim(after), r"(?i)\s+(?:aadhaar|aadhar|pan|passport|visa|card|certificate|resume|cv)\b")[0])
    blocked = T.words(list(dict.fromkeys(V.FILLERS + V.ACTIONS + SIGNAL_WORDS + V.NO_NAMES)))
    others = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(blocked, t) & ~t.rlike(r"^\d+$"))
    signals = V.CATEGORY_SIGNALS["IDENTITY"]
    documents = F.arrays_overlap(tokens, T.words(V.OWNED_DOCUMENTS))
    if by_words:
        documents = documents | (hits_of(low, tokens, signals) > 0)
    else:
        for s in signals:
            documents = documents | low.contains(s)
    bare = (F.size(others).between(1, 3)) & documents & ~says_whose(query)
    none = F.array().cast("array<string>")
    return F.when((F.size(possessor) > 0) & ~is_self, possessor).when(F.size(receiver) > 0, receiver).when(bare, others).otherwise(none)


def identity_tokens(name: list[str]) -> tuple[list[str], list[str]]:
    """(first and last, those between) of the tokens of a person's name."""
    primary = list(dict.fromkeys(name if len(name) <= 2 else [name[0], name[-1]]))
    return primary, [t for t in dict.fromkeys(name) if t not in primary] if len(name) > 2 else []


def own_groups(core: Column, name: list[str]) -> Column:
    """Groups of tokens by which to look for one's own files: first name and words of the document, then
    each other name with them, the last name last. ``name`` are the tokens of the asker's name."""
    possessives = T.words(V.POSSESSIVES)
    words = F.filter(core, lambda t: (F.length(t) >= 2) & ~F.array_contains(possessives, t))
    if not name:
        return F.array().cast("array<array<string>>")
    primary, between = identity_tokens(name)
    groups = [name[0], *between] + ([primary[-1]] if len(primary) >= 2 and primary[-1] != name[0] else [])
    return F.array_distinct(F.array(*[F.array_distinct(F.concat(F.array(F.lit(g)), words)) for g in groups]))


def retrieval_tokens(core: Column, lexical: Column, clean: Column) -> Column:
    """The tokens to look for: core, else lexical, else those of the clean query."""
    return F.when(F.size(core) > 0, core).when(F.size(lexical) > 0, lexical).otherwise(T.tokenize(clean))


def has_language(text: Column, language: Column) -> Column:
    """Whether a text is of a language, by its script or by what it says."""
    low = F.lower(text)
    says = lambda *words: F.exists(T.words(list(words)), lambda w: low.contains(w))
    script = lambda s: T.has_script(text, s)
    return (
        F.when(language.isin("hindi", "marathi"), script("devanagari") | says("hindi", "devanagari"))
        .when(language == "english", script("latin") & ~script("devanagari"))
        .when(language == "german", says("german", "deutsch") | script("latin") & low.rlike(rf"\b({'|'.join(V.GERMAN_WORDS)})\b"))
        .when(language == "french", says("french", "francais", "français")).when(language == "spanish", says("spanish", "espanol", "español"))
        .when(language == "italian", says("italian")).when(language == "portuguese", says("portuguese", "portugues"))
        .when(language == "dutch", says("dutch", "nederlands")).when(language == "russian", script("cyrillic") | says("russian"))
        .when(language == "tamil", script("tamil")).when(language == "telugu", script("telugu")).when(language == "bengali", script("bengali"))
        .when(language == "gujarati", script("gujarati")).when(language == "kannada", script("kannada")).when(language == "malayalam", script("malayalam"))
        .when(language == "punjabi", script("gurmukhi")).when(language.isin("urdu", "arabic"), script("arabic"))
        .when(language.isin("chinese", "japanese", "korean"), script("cjk")).otherwise(False)
    )


def language_factor(language: Column, name: Column, body: Column) -> Column:
    """How well a file's name and body fit the language that a query asks for; 1 if it asks for none."""
    in_name = has_language(name, language)
    in_body = has_language(body, language) | F.lower(body).contains(F.concat(language, F.lit(" language")))
    latin = T.has_script(name, "latin") & ~in_name
    f = V.LANGUAGE_FACTORS
    return F.when(language.isNull(), 1.0).when(in_name, f["name"]).when(in_body & ~latin, f["body"]).when(latin | ~in_name & ~in_body, f["none"]).otherwise(f["else"])


def index_extras(stem: Column, snippet: Column) -> Column:
    """What is added to the keywords of a file: aliases of the words of its name, names of its scripts, its language."""
    both = F.concat_ws(" ", stem, F.coalesce(snippet, F.lit("")))
    tokens = T.tokenize(F.regexp_replace(stem, r"[_\-.]", " "))
    scripts = T.scripts_of(both)
    others = F.filter(scripts, lambda s: s != "latin")
    language = F.concat(T.dominant_language(both), F.lit(" language"))
    named = F.array(F.when(F.array_contains(scripts, "devanagari"), "hindi devanagari"), F.when(F.array_contains(scripts, "cyrillic"), "russian cyrillic"))
    parts = F.concat(aliases_of(tokens), F.filter(named, lambda s: s.isNotNull()), others, F.filter(F.array(language), lambda s: s.isNotNull()))
    return F.array_join(F.array_distinct(parts), " ")
