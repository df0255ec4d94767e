"""How well a file answers a query. Both come as structs:

a *query* has core, lexical and synonym tokens, periods (in small letters), categories, kind, time,
language, target (tokens of the owner asked for) and person (whether it is a name); a *file* has what
``file_words`` gives. All is evaluated row by row in the JVM; patterns are asked of arrays of words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korrel.functions import owners as O
from korrel.functions import text as T
from korrel.functions import values as V
from korrel.functions.forms import language_factor


def file_words(path: Column, name: Column, extension: Column, metadata: Column, content: Column, entities: Column) -> Column:
    """What a file is searched by: its stem, and the words of its fields."""
    stem = T.stem_of(name)
    words = lambda text: T.stem_tokens(F.lower(F.coalesce(text, F.lit(""))))
    return F.struct(
        stem.alias("stem"), F.lower(name).alias("raw"), F.lower(extension).alias("ext"), T.stem_tokens(stem).alias("name"), words(F.element_at(F.split(path, "/"), -2)).alias("folder"),
        words(metadata).alias("metadata"), words(content).alias("content"), words(entities).alias("entity"),
    )


def has_word(words: Column, token: Column) -> Column:
    """Whether a token is among words; one of two characters may begin or end one."""
    return F.when(F.length(token) >= 3, F.array_contains(words, token)).otherwise(F.exists(words, lambda w: w.startswith(token) | w.endswith(token)))


def in_any_field(file: Column, token: Column) -> Column:
    """Whether a token is in a file's name, description, text or entities, or glued to a word of its name."""
    found = F.exists(file["name"], lambda w: T.glued_match(w, token))
    for field in ("name", "metadata", "content", "entity"):
        found = found | has_word(file[field], token)
    return found


def n_of(tokens: Column, test) -> Column:
    """How many tokens pass a test."""
    return F.size(F.filter(tokens, test))


def is_named(name_word: Column, tokens: Column) -> Column:
    """Whether a word of a name is one of the tokens, or begins or ends with one of two characters."""
    return F.exists(tokens, lambda q: (name_word == q) | (F.length(q) <= 2) & (name_word.startswith(q) | name_word.endswith(q)))


def name_coverage(name: Column, tokens: Column) -> Column:
    """The share of a name's words that tokens name; 0 without any."""
    return F.when((F.size(name) > 0) & (F.size(tokens) > 0), n_of(name, lambda w: is_named(w, tokens)) / F.size(name)).otherwise(0.0)


def names_all(name: Column, tokens: Column) -> Column:
    """Whether a name has every token; false without any."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda q: F.exists(name, lambda w: (w == q) | (F.length(q) <= 2) & (w.startswith(q) | w.endswith(q))))


def is_title(file: Column, core: Column) -> Column:
    """Whether a query of two tokens or more is the title of a file: all in its name, and nearly all of the name."""
    found = n_of(core, lambda t: has_word(file["name"], t) | F.exists(file["name"], lambda w: T.glued_match(w, t)))
    return (F.size(core) >= 2) & names_all(file["name"], core) & (name_coverage(file["name"], core) >= 0.85) & (found >= F.size(core) * 0.85)


def chained(score: Column, *factors: Column) -> Column:
    """A score times all factors, but not less than a fixed part of it; 0 if it isn't positive."""
    product = factors[0]
    for f in factors[1:]:
        product = product * f
    return F.when(score <= 0, 0.0).otherwise(score * F.greatest(product, F.lit(V.LEXICAL["floor"])))


def total(tokens: Column, each) -> Column:
    """The sum of what every token counts."""
    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + each(t))


def kind_factor(query: Column, ext: Column) -> Column:
    """How well a file's extension fits the kind or the media that a query asks for."""
    w, out = V.LEXICAL, F.lit(1.0)
    media = F.array_contains(query["categories"], "MEDIA") & F.arrays_overlap(query["core"], T.words(V.MEDIA_WORDS))
    rules = [(query["kind"] == "audio music", V.AUDIO, w["type_match"]), (query["kind"] == "video", V.VIDEO, w["type_match"]), (query["kind"] == "photo image", V.IMAGES, w["type_match"]), (media, V.AUDIO + V.VIDEO + V.IMAGES, w["media_match"])]
    for asked, known, factor in reversed(rules):
        out = F.when(asked, F.when(ext.isin(known), factor).when(ext.isin(V.DOCUMENTS), w["mismatch"]).otherwise(1.0)).otherwise(out)
    return out


def lexical_score(query: Column, file: Column, name: Column, body: Column, owners: Column, confidence: Column) -> Column:
    """The score of a file by words. ``name`` and ``body`` are its texts, for their language."""
    w, core = V.LEXICAL, query["core"]

    def token(t: Column) -> Column:
        in_name = (
            F.when((file["stem"] == t) | (file["raw"] == F.concat(t, F.lit("."), file["ext"])), w["name_exact"])
            .when(file["stem"].startswith(F.concat(t, F.lit(" "))) | file["stem"].endswith(F.concat(F.lit(" "), t)), w["name_edge"])
            .when(has_word(file["name"], t), w["name_inside"]).otherwise(0.0)
        )
        points = in_name + F.when(file["ext"] == t, w["extension"]).otherwise(0.0)
        for field in ("folder", "metadata", "content", "entity"):
            points = points + F.when(has_word(file[field], t), w[field]).otherwise(0.0)
        return points * F.when(F.array_contains(core, t), 1.0).otherwise(w["other"])

    score = total(F.array_distinct(F.concat(core, query["lexical"])), token)
    hits = n_of(core, lambda t: has_word(file["entity"], t))
    score = score + F.when(query["person"] & (F.size(core) > 0) & (F.size(file["entity"]) > 0), F.when(hits == F.size(core), w["person_all"]).otherwise(hits * w["person_each"])).otherwise(0.0)
    coverage = name_coverage(file["name"], core)
    score = score + coverage * V.WEIGHTS["coverage"] + F.when(coverage == 1.0, V.WEIGHTS["full_coverage"]).otherwise(0.0)
    score = score + total(query["periods"], lambda p: F.when(has_word(file["name"], p) | has_word(file["metadata"], p), w["period"]).otherwise(0.0))
    by_synonym = total(query["synonyms"], lambda t: F.when(has_word(file["name"], t), w["synonym_name"]).otherwise(0.0) + F.when(has_word(file["metadata"], t), w["synonym_metadata"]).otherwise(0.0))
    score = score + F.when((F.size(core) < 2) & (F.size(query["periods"]) == 0), by_synonym).otherwise(0.0)
    return chained(score, language_factor(query["language"], name, body), kind_factor(query, file["ext"]), O.owner_factor(owners, confidence, query["target"]))


def specific_factor(query: Column, file: Column) -> Column:
    """How specifically a file answers: all tokens, a strong name, the period asked for."""
    s, core = V.SPECIFIC, query["core"]
    ratio = F.when(F.size(core) == 0, 1.0).otherwise(n_of(core, lambda t: in_any_field(file, t)) / F.size(core))
    strong = F.exists(core, lambda t: (F.length(t) >= 3) & (has_word(file["name"], t) | F.exists(file["name"], lambda w: T.glued_match(w, t))))
    by_ratio = F.when(ratio >= 1, s["full"]).when(strong, s["strong_name"]).when((ratio >= 0.5) & (F.size(core) >= 2), F.greatest(ratio, F.lit(s["half_floor"]))).when(F.size(core) >= 2, F.greatest(ratio, F.lit(s["weak_floor"]))).otherwise(1.0)
    in_name = F.exists(query["periods"], lambda p: has_word(file["name"], p)) | file["stem"].rlike("q[1-4]")
    by_period = F.when(F.size(query["periods"]) == 0, 1.0).when(in_name, s["period"]).otherwise(s["period_miss"])
    by_name = F.when((F.size(core) >= 2) & names_all(file["name"], core), s["all_in_name"]).otherwise(1.0)
    return F.when((F.size(core) == 0) & (F.size(query["periods"]) == 0), 1.0).otherwise(F.least(F.lit(s["cap"]), by_ratio * by_period * by_name))


def dense_bonus(part: Column, place: Column, cosine: Column) -> Column:
    """What a high place among the nearest vectors adds, most where words say little. Places count from 1."""
    r = V.RERANK
    ladder = lambda steps: F.coalesce(*[F.when(place <= last + 1, bonus) for last, bonus in steps], F.lit(0.0))
    return F.when(place.isNull(), 0.0).when(part < r["rescue_below"], ladder(r["rescue"])).when(cosine < r["dense_above"], 0.0).otherwise(ladder(r["dense"]))


def rerank_score(query: Column, file: Column, part: Column, cosine: Column, dense_place: Column, name: Column, body: Column, categories: Column, age: Column, owners: Column, confidence: Column) -> Column:
    """The final score of a candidate, 0 to 1. ``part`` is its lexical score as a part of the query's
    highest, ``dense_place`` its place among the nearest vectors (null outside)."""
    r, core = V.RERANK, query["core"]
    title = is_title(file, core)
    holds = {"title": title, "person": query["person"], "period": (F.size(query["periods"]) > 0) & (part > r["period_above"]), "strong": part > r["strong_above"], "weak": part < r["weak_below"], "else": F.lit(True)}
    score = None
    for branch, lexical, dense in reversed(r["branches"]):
        mixed = part * lexical + cosine * dense
        score = mixed if score is None else F.when(holds[branch], mixed).otherwise(score)
    n_core = F.greatest(F.size(core), F.lit(1))
    covered = n_of(core, lambda t: has_word(file["entity"], t)) / n_core
    score = score + n_of(query["lexical"], lambda t: in_any_field(file, t)) / n_core * r["overlap"] + name_coverage(file["name"], core) * r["coverage"]
    score = score + F.when(title, r["title"]).otherwise(0.0) + F.when(names_all(file["name"], core), r["all_in_name"]).otherwise(0.0)
    score = score + F.when(covered >= 1, r["entity_full"]).otherwise(covered * r["entity_part"]) + F.when(query["person"] & (covered > 0), r["person_entity"]).otherwise(0.0)
    score = score + dense_bonus(part, dense_place, cosine)
    by_category = F.when(F.arrays_overlap(query["categories"], categories), r["category"]).otherwise(1.0)
    by_time = F.when(query["time"] == age, r["time"]).otherwise(1.0)
    whole = chained(score, language_factor(query["language"], name, body), by_category, by_time, specific_factor(query, file), O.owner_factor(owners, confidence, query["target"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole))
