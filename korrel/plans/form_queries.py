"""Queries over past and sample searches: what each says, in which language, and whose files it asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import forms as Q
from korrel.functions import text as T
from korrel.functions import values as V
from korrel.plans.index_queries import TOKENS
from korrel.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Searches in which the word lists have something to find, beside those of the tables.
SAMPLES = [
    "python notes in hindi", "Mera PAN card dhundo", "find my aadhaar info please", "geburtstagfotos auf deutsch", "Mudith Certificate", "certificate mudith", "John Smith", "sarah passport", "old tax file",
    "share quarterly report Q2 on whatsapp", "resume for Anna Berg", "Otto's passport", "my pancard", "holi video", "song", "in tamil", "budget budget plan quarter 3", "latest invoice, facture?", "kaam ki file", "me",
    "photo of visa", "document", "word document", "x", "  ", "2024", "birth certificate anna", "mein Lebenslauf", "meeting minutes in english or hindi mein",
]
#: The tokens of the asker's name.
ASKER = ["mudith", "raj", "shetty"]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different past, golden and sample search."""
    past = table(spark, sf_dir, "search_completed").select("query").unionByName(table(spark, sf_dir, "golden_queries").select("query"))
    return past.unionByName(spark.createDataFrame([(q,) for q in SAMPLES], "query string")).where("query IS NOT NULL").distinct()


def texts(values: list[str]) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pairs(values: dict[str, str]) -> str:
    """A SQL map of strings."""
    return f"map({texts(list(values))}, {texts(list(values.values()))})"


ASKED = f"asked AS (SELECT DISTINCT query FROM (SELECT query FROM search_completed UNION ALL SELECT query FROM golden_queries UNION ALL SELECT unnest({texts(SAMPLES)})) WHERE query IS NOT NULL)"


def _language() -> tuple[str, str]:
    """(the query without language phrases, the language that it asks for), in SQL."""
    text, hint = "lower(query)", "NULL"
    for lang, phrases in V.LANGUAGE_PHRASES.items():
        for p in sorted(phrases, key=len, reverse=True):
            hint = f"CASE WHEN contains({text}, '{p}') THEN '{lang}' ELSE {hint} END"
            text = f"replace({text}, '{p}', ' ')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))", hint


STRIPPED, HINT = _language()
EVERYDAY = r"array_to_string(list_transform(list_filter(list_transform(string_split_regex(lower({0}), '\s+'), lambda w: trim(w, '.,?!""''')), lambda w: trim(w) <> ''), lambda w: coalesce(" + pairs(V.COLLOQUIAL) + "[w], w)), ' ')"
EVERYDAY = EVERYDAY.replace('""', '"')
UNSTOPPED = r"array_to_string(list_filter(string_split_regex(lower({0}), '\s+'), lambda w: length(w) > 1 AND NOT list_contains(" + texts(Q.STOPS) + ", w)), ' ')"
FIRST = f"array_to_string(({TOKENS})[1:{Q.CLEAN_WORDS}], ' ')"
CORE = f"list_filter({TOKENS}, lambda t: NOT list_contains({texts(Q.STOPS)}, t))"


def or_else(text: str, other: str) -> str:
    return f"CASE WHEN trim({text}) <> '' THEN {text} ELSE {other} END"


FORMS = f"""{ASKED}, a AS (SELECT query, {STRIPPED} AS stripped, {HINT} AS language FROM asked),
b AS (SELECT *, {UNSTOPPED.format(EVERYDAY.format('stripped'))} AS plain, {FIRST.format('stripped')} AS first_words FROM a),
c AS (SELECT *, {or_else(FIRST.format('plain'), 'first_words')} AS embed FROM b),
d AS (SELECT *, {or_else('embed', 'stripped')} AS base, {CORE.format(or_else('embed', 'stripped'))} AS core FROM c),
e AS (SELECT *, {UNSTOPPED.format(EVERYDAY.format('base'))} AS again FROM d),
forms AS (SELECT *, {or_else(FIRST.format('again'), 'lower(trim(base))')} AS clean FROM e)"""
ALIAS_MAP = f"map({texts(list(Q.ALIASES))}, [{', '.join(texts(v) for v in Q.ALIASES.values())}])"


def forms(df: DataFrame) -> DataFrame:
    """``df`` of queries with language, stripped, embed, core and clean forms."""
    said = df.withColumn("a", Q.asked_language(F.col("query"))).select(*df.columns, F.col("a.hint").alias("language"), F.col("a.stripped").alias("stripped"))
    said = said.withColumn("embed", Q.embed_text(F.col("stripped"))).withColumn("base", Q.or_else(F.col("embed"), F.col("stripped")))
    return said.withColumns({"core": Q.core_of(F.col("base")), "clean": Q.clean_query(F.col("base"))})


@query(f"WITH {FORMS} SELECT query, language, stripped, embed, array_to_string(core, ' ') AS core, clean FROM forms")
def query_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that every search asks for, and its clean forms."""
    return forms(asked(spark, sf_dir)).select("query", "language", "stripped", "embed", F.array_join("core", " ").alias("core"), "clean")


@query(
    f"""WITH {FORMS}, t AS (SELECT query, CASE WHEN len(core) > 0 THEN core ELSE {TOKENS.format('stripped')} END AS tokens FROM forms)
SELECT query, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(tokens, lambda t: list_concat([t], coalesce({ALIAS_MAP}[t], [])))), lambda t: length(t) > 1))), ' ') AS aliases FROM t"""
)
def query_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every search with all words of their meaning, in code-point order."""
    said = forms(asked(spark, sf_dir)).withColumn("tokens", F.when(F.size("core") > 0, F.col("core")).otherwise(T.tokenize(F.col("stripped"))))
    return said.select("query", F.array_join(F.array_sort(Q.aliases_of(F.col("tokens"))), " ").alias("aliases"))


@query(f"WITH {FORMS} SELECT query, concat_ws(' ', clean, {', '.join(f'CASE WHEN list_contains({TOKENS.format(chr(99) + chr(108) + chr(101) + chr(97) + chr(110))}, {texts([w])[1:-1]}) THEN {texts([m])[1:-1]} END' for w, m in V.SYNONYMS.items())}) AS expanded FROM forms")
def query_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clean search followed by what its words stand for."""
    return forms(asked(spark, sf_dir)).select("query", Q.with_synonyms(F.col("clean")).alias("expanded"))


def hits_sql(text: str, tokens: str, signals: list[str]) -> str:
    phrases = [s for s in signals if " " in s]
    return f"(len(list_intersect({texts([s for s in signals if ' ' not in s])}, {tokens}))" + "".join(f" + CAST(contains({text}, '{p}') AS INT)" for p in phrases) + ")"


def two_best_sql(scores: list[tuple[str, str, str]]) -> str:
    every = ", ".join(f"{{'s': -({score}), 'o': {order}, 'n': '{name}'}}" for name, score, order in scores)
    return f"list_transform(list_sort(list_filter([{every}], lambda x: x.s < 0))[1:2], lambda x: x.n)"


KIND = "CASE " + " ".join(
    rf"WHEN regexp_matches(lower(query), '\b(?:{'|'.join(t for t in ts.split() if t not in ('file', 'document', 'doc'))})\b')" + (rf" OR n_clean < 2 AND regexp_matches(lower(query), '\b(?:file|document|doc)\b')" if "doc" in ts.split() else "") + f" THEN '{name}'" for name, ts in V.TYPE_HINTS
) + " END"


@query(
    rf"""WITH {FORMS}, n AS (SELECT query, clean, len(list_filter(string_split_regex(clean, '\s+'), lambda t: trim(t) <> '')) AS n_clean, lower(query) AS low, {TOKENS.format('query')} AS tokens FROM forms)
SELECT query, array_to_string({two_best_sql([(c, hits_sql('low', 'tokens', s), str(i)) for i, (c, s) in enumerate(V.CATEGORY_SIGNALS.items())])}, ',') AS categories, {KIND} AS kind FROM n"""
)
def query_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories and the kind of file that every search points to."""
    said = forms(asked(spark, sf_dir))
    return said.select("query", F.array_join(Q.asked_categories(F.col("query")), ",").alias("categories"), Q.asked_type(F.col("query"), F.col("clean")).alias("kind"))


LIKE_NAME = r"(length(trim({0})) BETWEEN 2 AND 50 AND NOT regexp_matches(trim({0}), '^\d+$') AND NOT list_contains(" + texts(V.PARTY_WORDS) + r", lower(trim({0}))) AND length(regexp_replace({0}, '[^\p{{L}}ऀ-ॿ]', '', 'g')) >= length(trim({0})) // 2)"
LETTER = "A-Za-zऀ-ॿ"
NAME_TOKENS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-zऀ-ॿ\s]', ' ', 'g'), '\s+'), lambda t: length(t) >= 2))"


@query(
    f"""WITH {FORMS}, k AS (SELECT query, list_filter(core, lambda t: length(t) >= 2) AS kept FROM forms)
SELECT query, len(kept) BETWEEN 1 AND 2 AND len(list_intersect(list_transform(kept, lambda t: lower(t)), {texts(Q.SIGNAL_WORDS)})) = 0 AND len(list_filter(kept, lambda t: NOT {LIKE_NAME.format('t')})) = 0 AS person FROM k"""
)
def query_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every search is a person's name."""
    return forms(asked(spark, sf_dir)).select("query", Q.asks_for_person(F.col("core")).alias("person"))


BLOCKED = texts(list(dict.fromkeys(V.FILLERS + V.ACTIONS + Q.SIGNAL_WORDS + V.NO_NAMES)))
POSSESSIVE = rf"regexp_matches(lower(query), '(^|[^a-z0-9_])(?:{'|'.join(V.POSSESSIVES)})($|[^a-z0-9_])')"


@query(
    rf"""WITH {FORMS}, n AS (SELECT *, {TOKENS.format('query')} AS tokens, {POSSESSIVE} AS own, {NAME_TOKENS.format(f"regexp_extract(query, '(?i)" + chr(92) + f"b([{LETTER}][{LETTER}" + chr(92) + "s.''-]{1,30})''s" + chr(92) + "b', 1)")} AS possessor,
  {NAME_TOKENS.format(f"string_split_regex(trim(regexp_extract(query, '(?i)" + chr(92) + f"b(?:for|of)" + chr(92) + f"s+([{LETTER}][{LETTER}" + chr(92) + "s.''-]{1,40})', 1)), '(?i)" + chr(92) + "s+(?:aadhaar|aadhar|pan|passport|visa|card|certificate|resume|cv)" + chr(92) + "b')[1]")} AS receiver FROM forms),
m AS (SELECT *, list_filter(tokens, lambda t: length(t) >= 3 AND NOT list_contains({BLOCKED}, t) AND NOT regexp_matches(t, '^\d+$')) AS others, len(list_intersect(tokens, {texts(V.OWNED_DOCUMENTS)})) > 0 OR {hits_sql('lower(query)', 'tokens', V.CATEGORY_SIGNALS['IDENTITY'])} > 0 AS paper FROM n),
o AS (SELECT *, CASE WHEN len(possessor) > 0 AND NOT (own AND list_sort(possessor) = list_sort({texts(ASKER)})) THEN possessor WHEN len(receiver) > 0 THEN receiver WHEN len(others) BETWEEN 1 AND 3 AND paper AND NOT own THEN others ELSE [] END AS named FROM m),
w AS (SELECT *, list_filter(core, lambda t: length(t) >= 2 AND NOT list_contains({texts(V.POSSESSIVES)}, t)) AS words FROM o)
SELECT query, CASE WHEN len(named) > 0 THEN 'NAMED' WHEN own THEN 'SELF' ELSE 'NONE' END AS intent, array_to_string(list_sort(CASE WHEN len(named) > 0 THEN named WHEN own THEN {texts(ASKER)} ELSE [] END), ' ') AS target,
  CASE WHEN len(named) = 0 AND own THEN array_to_string(list_transform(['mudith', 'raj', 'shetty'], lambda g: array_to_string(list_concat([g], list_filter(words, lambda x: x <> g)), ' ')), '|') ELSE array_to_string(CASE WHEN len(core) > 0 THEN core ELSE {TOKENS.format('clean')} END, ' ') END AS groups FROM w"""
)
def query_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose files every search asks for, and the groups of tokens to look for."""
    said = forms(asked(spark, sf_dir)).withColumn("named", Q.named_owner(F.col("query"), ASKER)).withColumn("own", (F.size("named") == 0) & Q.says_whose(F.col("query")))
    asker = T.words(ASKER)
    groups = F.transform(Q.own_groups(F.array_distinct("core"), ASKER), lambda g: F.array_join(g, " "))
    return said.select(
        "query", F.when(F.size("named") > 0, "NAMED").when(F.col("own"), "SELF").otherwise("NONE").alias("intent"),
        F.array_join(F.array_sort(F.when(F.size("named") > 0, F.col("named")).when(F.col("own"), asker).otherwise(F.array().cast("array<string>"))), " ").alias("target"),
        F.when(F.col("own"), F.array_join(groups, "|")).otherwise(F.array_join(Q.retrieval_tokens(F.col("core"), Q.aliases_of(F.col("core")), F.col("clean")), " ")).alias("groups"),
    )


PLAIN = r"regexp_replace(trim(query), '\s+', ' ', 'g')"


@query(
    f"""WITH {ASKED}, a AS (SELECT query, {PLAIN} AS plain, {STRIPPED.replace('lower(query)', f'lower({PLAIN})')} AS stripped, {HINT.replace('lower(query)', f'lower({PLAIN})')} AS language FROM asked), b AS (SELECT *, {UNSTOPPED.format(EVERYDAY.format('stripped'))} AS words FROM a)
SELECT query, concat_ws(' ', {or_else('words', or_else('stripped', 'plain'))}, CASE WHEN language IS NOT NULL THEN concat('in ', language) END) AS shown FROM b"""
)
def query_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search as it would be shown after speaking it."""
    return asked(spark, sf_dir).select("query", Q.spoken(F.col("query")).alias("shown"))
