"""The whole search: candidates, scores by words, nearest vectors, fusion, reranking, a wider second pass.

Every step is one plan over all queries. Candidates come from equality joins with the postings of
tokens and are cut to a bounded number for each query before any file is scored, so scoring costs
queries times pool, not queries times files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korrel.functions import forms as Q
from korrel.functions import owners as O
from korrel.functions import scoring as S
from korrel.functions import text as T
from korrel.functions import values as V
from korrel.functions import vectors as VX
from korrel.operators import retrieval as R
from korrel.operators.enrichment import enriched
from korrel.session import cut


def prepared(queries: DataFrame, asker: list[str] | None = None, year: int | None = None) -> DataFrame:
    """(qid, query, q): of (qid, query) the struct that ``functions.scoring`` asks files for. ``asker``
    are the name tokens of who asks."""
    asker = asker or []
    said = enriched(queries.select("qid", "query"), year=year).withColumn("a", Q.asked_language(F.col("query")))
    said = said.withColumn("stripped", F.col("a.stripped")).withColumn("embed", Q.embed_text(F.col("stripped")))
    said = said.withColumn("base", Q.or_else(F.col("embed"), F.col("stripped")))
    said = said.withColumns({"core0": Q.core_of(F.col("base")), "clean": Q.clean_query(F.col("base")), "named": Q.named_owner(F.col("query"), asker)})
    own = (F.size("named") == 0) & Q.says_whose(F.col("query")) & F.lit(bool(asker))
    possessives = T.words(V.POSSESSIVES)
    said = said.withColumn("own", own).withColumn("core", F.when(own, F.filter("core0", lambda t: ~F.array_contains(possessives, t))).otherwise(F.col("core0")))
    target = F.when(F.col("own"), T.words(asker) if asker else F.array().cast("array<string>")).otherwise(F.col("named"))
    lexical = Q.aliases_of(F.when(F.size("core") > 0, F.col("core")).otherwise(T.tokenize(F.col("stripped"))))
    said = said.withColumn("target", target).withColumn("lexical", F.array_distinct(F.concat(lexical, F.col("target"))))
    more = F.array_except(T.tokenize(Q.with_synonyms(F.col("clean"))), F.concat("core", "lexical"))
    groups = F.when(F.col("own"), Q.own_groups(F.col("core"), asker)).otherwise(F.array(Q.retrieval_tokens(F.col("core"), F.col("lexical"), F.col("clean"))))
    return said.select(
        "qid", "query",
        F.struct(
            "core", "lexical", F.slice(more, 1, V.LEXICAL["most_synonyms"]).alias("synonyms"), F.transform("quarters", lambda x: F.lower(x)).alias("periods"), Q.asked_categories(F.col("query")).alias("categories"),
            Q.asked_type(F.col("query"), F.col("clean")).alias("kind"), F.col("time_hint").alias("time"), F.col("a.hint").alias("language"), "target", Q.asks_for_person(F.col("core")).alias("person"), groups.alias("groups"), "clean",
        ).alias("q"),
    )


@dataclass
class Library:
    """The files that are searched: (id, device_id, path, name, extension, ...) of the index, one row for
    each file, with arrays ``categories`` and ``owners``; the postings of their fields, and keyword texts."""

    files: DataFrame
    postings: DataFrame
    keywords: DataFrame
    size: int


def library(files: DataFrame, keyword_texts: DataFrame, postings: DataFrame | None = None) -> Library:
    """The library of the current rows of an index. ``postings`` may be a stored table of them."""
    known = T.words(V.CATEGORIES)
    whole = files.withColumns({"owners": O.owners_of_json(F.col("owner_names")), "categories": F.filter(F.split(F.upper("categories"), r"[^A-Z]+"), lambda c: F.array_contains(known, c))})
    keyed = keyword_texts.join(files.select("id", "device_id", "path"), ["device_id", "path"]).select("id", "keywords")
    return Library(whole, postings if postings is not None else R.postings(files), keyed, files.count())


def _groups(asked: DataFrame) -> DataFrame:
    """(qid, g, n_tokens, token): the tokens of every group of a query."""
    each = asked.select("qid", F.posexplode("q.groups").alias("g", "tokens")).withColumn("tokens", F.array_distinct("tokens"))
    return each.select("qid", "g", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))


def field_matches(asked: DataFrame, lib: Library, fields: list[str], most: int, enough: int = 3) -> DataFrame:
    """(qid, id, tier, ord): files that hold a group of tokens in fields. All files with every token, if
    there are ``enough``; else those with any too; at most ``most``, the fullest and then the newest first."""
    hits = lib.postings.where(F.col("field").isin(fields)).join(_groups(asked), "token")
    found = hits.groupBy("qid", "g", "id", "n_tokens").agg(F.count_distinct("token").alias("n"))
    best = found.groupBy("qid", "id").agg(F.max(F.col("n") / F.col("n_tokens")).alias("share"))
    full = F.sum(F.when(F.col("share") == 1, 1).otherwise(0)).over(W.partitionBy("qid"))
    kept = best.withColumn("n_full", full).where((F.col("share") == 1) | (F.col("n_full") < enough))
    dated = kept.join(lib.files.select("id", "last_modified"), "id")
    order = W.partitionBy("qid").orderBy(F.desc("share"), F.desc("last_modified"), "id")
    ranked = dated.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most)
    return ranked.select("qid", "id", F.when(F.col("share") == 1, "strict").otherwise("relaxed").alias("tier"), "ord")


def keyword_tiers(asked: DataFrame, lib: Library, most: int) -> DataFrame:
    """(qid, id, score, ord): files by keywords on three tiers: all clean tokens at once, each token, any
    synonym. A tier's weight is divided by the place there, the highest of all tiers counts."""
    tokens = asked.select("qid", F.array_distinct(T.tokenize(F.col("q.clean"))).alias("tokens"), "q.synonyms")
    spread = lambda column: tokens.select("qid", F.size(column).alias("n_tokens"), F.explode(column).alias("token"))
    each, more = spread(F.col("tokens")), spread(F.col("synonyms"))
    scored = cut(R.bm25_terms(each.unionByName(more).select("token").distinct(), lib.keywords, "id", "keywords"))
    by_token = each.join(scored, "token")
    every = by_token.groupBy("qid", "id", "n_tokens").agg(F.count("*").alias("n"), F.sum("weight").alias("score")).where((F.col("n") == F.col("n_tokens")) & (F.col("n_tokens") > 1))
    any_more = more.join(scored, "token").groupBy("qid", "id").agg(F.sum("weight").alias("score"))

    def tier(found: DataFrame, weight: float, by: list[str]) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "id")
        ranked = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
        return ranked.select("qid", "id", (F.lit(weight) / F.col("k")).alias("score"))

    t = V.KEYWORD_TIERS
    merged = tier(every, t["all"], ["qid"]).unionByName(tier(by_token.withColumnRenamed("weight", "score"), t["each"], ["qid", "token"])).unionByName(tier(any_more, t["synonyms"], ["qid"]))
    best = merged.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return R.best(best, most).select("qid", "id", "score", F.col("place").alias("ord"))


def candidates(asked: DataFrame, lib: Library, names: DataFrame, words: DataFrame, wide: bool = False) -> DataFrame:
    """(qid, id, tier, pos): what is scored for each query: files by name (``names``), by content, by
    keywords (``words``), of the categories asked for, and the newest where a query isn't specific and
    keywords find little."""
    n = R.limits(lib.size, wide)
    contents = field_matches(asked, lib, ["content", "metadata", "entity"], n["token"]).select("qid", "id", "ord")
    wanted = asked.select("qid", F.explode("q.categories").alias("category"))
    order = W.partitionBy("category").orderBy(F.desc("last_modified"), "id")
    of_category = lib.files.select("id", "last_modified", F.explode(F.array_distinct("categories")).alias("category")).withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= n["category"])
    by_category = wanted.join(of_category, "category").groupBy("qid", "id").agg(F.min("ord").alias("ord"))
    few = words.groupBy("qid").agg(F.count("*").alias("n"))
    vague = (F.size("q.core") < 2) & (F.size("q.periods") == 0) | (F.size("q.categories") == 0)
    open_queries = asked.join(few, "qid", "left").where(vague & (F.coalesce("n", F.lit(0)) < (80 if wide else 40))).select("qid")
    newest = lib.files.select("id", "last_modified").orderBy(F.desc("last_modified"), "id").limit(n["recent"]).withColumn("ord", F.row_number().over(W.orderBy(F.desc("last_modified"), "id")))
    recent = open_queries.crossJoin(F.broadcast(newest.select("id", "ord")))  # at most as many rows as the limit says
    return R.pooled([(names.select("qid", "id", "ord"), True), (contents, True), (words.select("qid", "id", "ord"), False), (by_category, False), (recent, False)], n["candidates"])


def _rows(pairs: DataFrame, asked: DataFrame, lib: Library) -> DataFrame:
    """``pairs`` of (qid, id, ...) with the query's struct ``q`` and the file's columns and words ``f``."""
    f = lib.files
    words = S.file_words(F.col("path"), F.col("name"), F.col("extension"), F.col("metadata_str"), F.col("content_snip"), F.col("entities"))
    body = F.concat_ws(" ", F.lower("metadata_str"), F.lower("content_snip"))
    return pairs.join(f.select("id", "name", words.alias("f"), body.alias("body"), "owners", "owner_confidence", "categories", "age_bucket"), "id").join(asked.select("qid", "q"), "qid")


def scored(pairs: DataFrame, asked: DataFrame, lib: Library) -> DataFrame:
    """(qid, id, score): the positive scores by words of pairs (qid, id)."""
    score = S.lexical_score(F.col("q"), F.col("f"), F.col("name"), F.col("body"), F.col("owners"), F.col("owner_confidence"))
    return _rows(pairs.select("qid", "id"), asked, lib).select("qid", "id", score.alias("score")).where("score > 0")


def one_pass(asked: DataFrame, lib: Library, names: DataFrame, keyed: DataFrame, dense: DataFrame, vectors: DataFrame, query_vectors: DataFrame, most: int, wide: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, lexical list, rerank pool) of one pass. ``names`` and ``keyed`` are the files by name and
    by keywords, ``dense`` (qid, id, score, place) the nearest vectors, ``vectors`` (id, v) those of all
    files, ``query_vectors`` (qid, q)."""
    n = R.limits(lib.size, wide)
    pool = candidates(asked, lib, names, keyed, wide)
    words = cut(R.best(scored(pool, asked, lib), n["lexical"]))
    fused = R.fused([(words, V.FUSION["lexical"]), (dense, V.FUSION["dense"])], n["fused"])
    exact = names.where((F.col("tier") == "strict") & (F.col("ord") <= n["exact_pins"]))
    sources = [
        (exact.select("qid", "id", (-F.col("ord")).alias("ord")), False), (fused.select("qid", "id", F.col("place").alias("ord")), False),
        (dense.where(F.col("place") <= n["dense_pins"]).select("qid", "id", F.col("place").alias("ord")), False), (words.where(F.col("place") <= n["lexical_pins"]).select("qid", "id", F.col("place").alias("ord")), False),
    ]
    chosen = cut(R.pooled(sources, n["rerank_pool"]))
    unit = chosen.join(vectors, "id").join(query_vectors, "qid").select("qid", "id", VX.cosine(F.col("q"), F.col("v")).alias("cosine")).where("cosine IS NOT NULL")
    top = words.groupBy("qid").agg(F.greatest(F.max("score"), F.lit(1.0)).alias("top"))
    both = unit.join(words.select("qid", "id", F.col("score").alias("lexical"), F.col("place").alias("lexical_place")), ["qid", "id"], "left").join(dense.select("qid", "id", F.col("place").alias("dense_place")), ["qid", "id"], "left").join(top, "qid", "left")
    part = F.coalesce("lexical", F.lit(0.0)) / F.coalesce("top", F.lit(1.0))
    rows = _rows(both.withColumn("part", part), asked, lib)
    score = S.rerank_score(F.col("q"), F.col("f"), F.col("part"), F.col("cosine"), F.col("dense_place"), F.col("name"), F.col("body"), F.col("categories"), F.col("age_bucket"), F.col("owners"), F.col("owner_confidence"))
    final = rows.select("qid", "id", score.alias("score"), S.is_title(F.col("f"), F.col("q.core")).alias("pin"), "lexical_place", "dense_place")
    return with_pins(final, most), words, chosen


def with_pins(final: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of (qid, id, score, pin, ...) with their ``place``, where pinned ones come in even
    if others score higher (the best of them, at most ``most``)."""
    first = W.partitionBy("qid").orderBy(F.desc("pin"), F.desc("score"), "id")
    ranked = final.withColumn("k", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).withColumn("p", F.row_number().over(first))
    n_late = F.sum(F.when(F.col("pin") & (F.col("k") > most) & (F.col("p") <= most), 1).otherwise(0)).over(W.partitionBy("qid"))
    late = F.col("pin") & (F.col("k") > most) & (F.col("p") <= most)
    # of the unpinned ones as many of the last leave as pinned ones come in
    open_place = F.sum(F.when(~F.col("pin"), 1).otherwise(0)).over(W.partitionBy("qid").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    n_open = F.sum(F.when(~F.col("pin") & (F.col("k") <= most), 1).otherwise(0)).over(W.partitionBy("qid"))
    stays = (F.col("k") <= most) & (F.col("pin") | (F.col("open_place") <= F.col("n_open") - F.col("n_late")))
    marked = ranked.withColumn("n_late", n_late).withColumn("late", late).withColumn("open_place", open_place).withColumn("n_open", n_open)
    taken = marked.where(F.col("late") | stays).drop("k", "p", "n_late", "late", "open_place", "n_open")
    return R.best(taken, most)


def needs_wider(asked: DataFrame, results: DataFrame, words: DataFrame, dense: DataFrame) -> DataFrame:
    """(qid, n, top): queries whose results are none, or too low, or by weak vectors alone."""
    f = V.FALLBACK
    got = results.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    by_words, near = words.groupBy("qid").agg(F.count("*").alias("n_words")), dense.groupBy("qid").agg(F.max("score").alias("nearest"))
    all_of = asked.select("qid").join(got, "qid", "left").join(by_words, "qid", "left").join(near, "qid", "left")
    low = F.coalesce("top", F.lit(0.0)) < f["low"]
    return all_of.where(F.col("n").isNull() | low | (F.col("n_words").isNull() & (F.coalesce("nearest", F.lit(0.0)) < f["weak_dense"]))).select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"))


def better_of(results: DataFrame, wider: DataFrame) -> DataFrame:
    """Of two passes (qid, id, score, ...) for each query the better one: the wider if its best score is
    higher by a margin, or not lower where the first was too low."""
    f = V.FALLBACK
    a, b = (x.groupBy("qid").agg(F.max("score").alias(name)) for x, name in ((results, "a"), (wider, "b")))
    takes = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b") > F.col("a") + f["margin"]) | (F.col("a") < f["low"]) & (F.col("b") >= F.col("a")))
    chosen = a.join(b, "qid", "full_outer").select("qid", takes.alias("wide"))
    return results.join(chosen.where("NOT wide"), "qid", "left_semi").unionByName(wider.join(chosen.where("wide"), "qid", "left_semi"))


def query_vectors(keyed: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, q): the mean unit vector of a query's five best files by keywords, where no encoder gives its own."""
    seeds = keyed.where(F.col("ord") <= 5).select("qid", "id").join(vectors, "id").where(VX.usable(F.col("v"))).select("qid", F.posexplode(VX.unit(F.col("v"))).alias("i", "x"))
    mean = seeds.groupBy("qid", "i").agg(F.avg("x").alias("x")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("q"))
    return mean.withColumn("q", VX.unit(F.col("q")))


def search(queries: DataFrame, lib: Library, most: int = 20, asker: list[str] | None = None, given: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, place, lexical_place, dense_place): the best files of each of (qid, query). ``given``
    are the queries' vectors (qid, q) of an encoder. Queries that the first pass answers badly are
    asked again with wider limits. Queries without any token, null ones too, find nothing by words."""
    asked, n = cut(prepared(queries, asker)), R.limits(lib.size)
    vectors = lib.files.select("id", F.col("embedding").alias("v"))
    names, keyed = cut(field_matches(asked, lib, ["name"], n["token"])), cut(keyword_tiers(asked, lib, n["keyword"]))
    own = cut(given if given is not None else query_vectors(keyed, vectors))
    dense = cut(R.nearest(own, vectors, n["dense"]))
    results, words, _ = one_pass(asked, lib, names, keyed, dense, vectors, own, most)
    results = cut(results)
    again = cut(asked.join(needs_wider(asked, results, words, dense), "qid", "left_semi"))
    if again.isEmpty():
        return results
    only = lambda df: df.join(again.select("qid"), "qid", "left_semi")
    wider, _, _ = one_pass(again, lib, only(names), cut(keyword_tiers(again, lib, R.limits(lib.size, True)["keyword"])), only(dense), vectors, own, most, wide=True)
    return better_of(results, cut(wider))
