"""Queries that search the index, and that look at past searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import forms as Q
from korrel.functions import text as T
from korrel.functions import values as V
from korrel.operators import enrichment, events
from korrel.operators import index as I
from korrel.operators import retrieval as R
from korrel.operators import search as SE
from korrel.plans.form_queries import ALIAS_MAP, FORMS, HINT, LIKE_NAME, hits_sql, texts, two_best_sql
from korrel.plans.form_queries import KIND as ASKED_KIND
from korrel.plans.index_queries import LATEST, STEM, TOKENS
from korrel.session import cut, table

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


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden queries, each its own id."""
    return table(spark, sf_dir, "golden_queries").select(F.col("query").alias("qid"), "query").distinct()


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest(table(spark, sf_dir, "indexed_files"))


EXPANDED = "clean, " + ", ".join(f"CASE WHEN list_contains({TOKENS.format('clean')}, {texts([w])[1:-1]}) THEN {texts([m])[1:-1]} END" for w, m in V.SYNONYMS.items())
ASKED = f"asked AS (SELECT qid, len(tokens) AS n_tokens, unnest(tokens) AS token FROM (SELECT DISTINCT query AS qid, list_distinct({TOKENS.format('query')}) AS tokens FROM golden_queries))"
POSTINGS = rf"""fields AS (
  SELECT id, 'name' AS field, list_distinct(list_filter(string_split_regex({STEM}, '\s+'), lambda t: trim(t) <> '')) AS tokens FROM latest
  UNION ALL SELECT id, 'content', list_distinct({TOKENS.format("coalesce(content_snip, '')")}) FROM latest
  UNION ALL SELECT id, 'metadata', list_distinct({TOKENS.format("coalesce(metadata_str, '')")}) FROM latest
  UNION ALL SELECT id, 'entity', list_distinct({TOKENS.format("coalesce(entities, '')")}) FROM latest
  UNION ALL SELECT id, 'extension', [lower(extension)] FROM latest),
postings AS (SELECT id, field, unnest(tokens) AS token FROM fields),
hits AS (SELECT a.qid, a.n_tokens, p.id, p.field, p.token FROM postings p JOIN asked a ON p.token = a.token)"""
#: The tokens of golden queries beside another table of the name ``asked``.
QTOKENS = ASKED.replace("asked AS", "golden_tokens AS", 1)
BASE = f"WITH {LATEST}, {ASKED}, {POSTINGS}"
LEXICAL = f"""summed AS (SELECT qid, id, n_tokens, sum(CASE field WHEN 'name' THEN 100.0 WHEN 'extension' THEN 40.0 WHEN 'content' THEN 35.0 WHEN 'metadata' THEN 8.0 ELSE 55.0 END) AS fields,
  count(DISTINCT CASE WHEN field = 'name' THEN token END) AS in_name FROM hits GROUP BY qid, id, n_tokens),
lexical AS (SELECT s.qid, s.id, s.fields + s.in_name / greatest(len(f.tokens), 1) * 80.0 + CASE WHEN s.in_name = s.n_tokens AND s.in_name > 0 THEN 100.0 ELSE 0.0 END AS score FROM summed s JOIN fields f ON f.id = s.id AND f.field = 'name')"""
BM25 = f"""docs AS (SELECT l.id, {TOKENS.format("coalesce(f.keywords, '')")} AS tokens FROM fts_index f JOIN latest l ON f.device_id = l.device_id AND f.path = l.path),
kept AS (SELECT * FROM docs WHERE len(tokens) > 0), stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS mean_len FROM kept),
terms AS (SELECT id, len(tokens) AS len, unnest(tokens) AS token FROM kept), tf AS (SELECT id, token, len, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
bm25 AS (SELECT a.qid, tf.id, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))) AS score FROM tf JOIN df USING (token) JOIN asked a USING (token), stats GROUP BY a.qid, tf.id)"""


def top(name: str, most: int) -> str:
    return f"SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM {name} QUALIFY place <= {most}"


@query(BASE + " SELECT qid, id FROM hits WHERE field = 'name' GROUP BY qid, id, n_tokens HAVING count(DISTINCT token) = n_tokens")
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose name holds all words of a golden query."""
    return R.full_matches(golden(spark, sf_dir), now(spark, sf_dir), ["name"])


@query(BASE + " SELECT qid, id FROM hits WHERE field IN ('content', 'metadata', 'entity') GROUP BY qid, id, n_tokens HAVING count(DISTINCT token) = n_tokens")
def search_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose text, description and entities hold all words of a golden query."""
    return R.full_matches(golden(spark, sf_dir), now(spark, sf_dir), ["content", "metadata", "entity"])


@query(
    BASE
    + """, n AS (SELECT qid, id, n_tokens, count(DISTINCT token) AS n FROM hits WHERE field = 'name' GROUP BY qid, id, n_tokens), s AS (SELECT *, sum(CASE WHEN n = n_tokens THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS n_strict FROM n)
SELECT qid, id, CASE WHEN n = n_tokens THEN 'strict' ELSE 'relaxed' END AS tier FROM s WHERE n_strict < 3 OR n = n_tokens"""
)
def search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by name: those with all words where there are enough, else those with any."""
    return R.tiered_matches(golden(spark, sf_dir), now(spark, sf_dir))


@query(f"{BASE}, {LEXICAL} {top('lexical', 50)}")
def search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the best weighted fields."""
    return R.best(R.lexical(golden(spark, sf_dir), now(spark, sf_dir)), 50).select("qid", "id", F.round("score", 6).alias("score"), "place")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fts_index").join(now(spark, sf_dir).select("id", "device_id", "path"), I.KEY)


@query(f"WITH {LATEST}, {ASKED}, {BM25} SELECT qid, id, round(score, 6) AS score FROM bm25")
def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword score of every file that holds a word of a golden query."""
    return R.bm25(golden(spark, sf_dir), _keyed(spark, sf_dir), "id", "keywords").select("qid", "id", F.round("score", 6).alias("score"))


@query(
    f"""{BASE}, {LEXICAL}, {BM25}, ranked AS (SELECT qid, id, 1.5 / (60 + row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id)) AS s, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS place FROM lexical
  UNION ALL SELECT qid, id, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id)), row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) FROM bm25),
fused AS (SELECT qid, id, sum(s) AS score FROM ranked WHERE place <= 100 GROUP BY qid, id)
SELECT qid, id, round(score, 8) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS place FROM fused QUALIFY place <= 30"""
)
def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and keyword ranks fused."""
    q, files = golden(spark, sf_dir), now(spark, sf_dir)
    lists = [R.best(x.withColumn("score", F.round("score", 6)), 100) for x in (R.lexical(q, files), R.bm25(q, _keyed(spark, sf_dir), "id", "keywords"))]
    summed = R.fused(list(zip(lists, (V.FUSION["lexical"], V.FUSION["dense"]))), 1_000_000).drop("place").withColumn("score", F.round("score", 12))
    return R.best(summed, 30).select("qid", "id", F.round("score", 8).alias("score"), "place")


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best files for every golden query by words, keywords and vectors together, reranked, with a
    wider second pass for queries that find little."""
    files = now(spark, sf_dir)
    found = SE.search(golden(spark, sf_dir), SE.library(files, table(spark, sf_dir, "fts_index")))
    return found.join(files.select("id", "device_id", "path"), "id").select("qid", "place", "id", "device_id", "path", F.round("score", 8).alias("score"))


def _pool(spark: SparkSession, sf_dir: str):
    """The golden queries prepared, the library, and the files that share a word with them in any field."""
    files = now(spark, sf_dir)
    lib = SE.library(files, table(spark, sf_dir, "fts_index"))
    asked = SE.prepared(golden(spark, sf_dir))
    return asked, lib, R.hits(golden(spark, sf_dir), files).select("qid", "id").distinct()


def _has(words: str, token: str) -> str:
    return f"(CASE WHEN length({token}) >= 3 THEN list_contains({words}, {token}) ELSE len(list_filter({words}, lambda w: starts_with(w, {token}) OR ends_with(w, {token}))) > 0 END)"


def _total(tokens: str, points: str) -> str:
    return f"coalesce(list_sum(list_transform({tokens}, lambda t: CAST({points} AS DOUBLE))), 0)"


L = V.LEXICAL
WORDS_OF = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '\s+'), lambda x: trim(x) <> '')"
NAMES_IT = "len(list_filter(core, lambda q: q = n OR length(q) <= 2 AND (starts_with(n, q) OR ends_with(n, q)))) > 0"
TOKEN_POINTS = (
    f"(CASE WHEN stem = t OR raw = concat(t, '.', ext) THEN {L['name_exact']} WHEN starts_with(stem, concat(t, ' ')) OR ends_with(stem, concat(' ', t)) THEN {L['name_edge']} WHEN {_has('name_words', 't')} THEN {L['name_inside']} ELSE 0 END"
    f" + CASE WHEN ext = t THEN {L['extension']} ELSE 0 END" + "".join(f" + CASE WHEN {_has(f, 't')} THEN {L[k]} ELSE 0 END" for k, f in (("folder", "folder_words"), ("metadata", "meta_words"), ("content", "content_words"), ("entity", "entity_words")))
    + f") * CASE WHEN list_contains(core, t) THEN 1.0 ELSE {L['other']} END"
)
IS_HINDI = f"(regexp_matches({{0}}, '[{V.SCRIPTS['devanagari']}]') OR contains(lower({{0}}), 'hindi') OR contains(lower({{0}}), 'devanagari'))"
#: The only language that the golden queries ask for.
HINDI_FACTOR = (
    f"CASE WHEN language IS NULL THEN 1.0 WHEN {IS_HINDI.format('file_name')} THEN 1.5 WHEN {IS_HINDI.format('body')} AND NOT regexp_matches(file_name, '[{V.SCRIPTS['latin']}]') THEN 1.2"
    f" WHEN regexp_matches(file_name, '[{V.SCRIPTS['latin']}]') OR NOT {IS_HINDI.format('body')} THEN 0.7 ELSE 0.85 END"
)
SCORED = rf"""q AS (SELECT f.query AS qid, core, {HINT} AS language, list_distinct(list_concat(core, flatten(list_transform(CASE WHEN len(core) > 0 THEN core ELSE {TOKENS.format('stripped')} END, lambda t: list_concat([t], coalesce({ALIAS_MAP}[t], [])))))) AS tokens,
  list_transform(regexp_extract_all(lower(f.query), '\b(?:q|quarter )([1-4])\b', 1), lambda x: concat('q', x)) AS periods, len(core) BETWEEN 1 AND 2 AND len(list_intersect(core, {texts(Q.SIGNAL_WORDS)})) = 0 AND len(list_filter(core, lambda t: NOT {LIKE_NAME.format('t')})) = 0 AS person,
  {two_best_sql([(c, hits_sql('lower(f.query)', TOKENS.format('f.query'), s), str(i)) for i, (c, s) in enumerate(V.CATEGORY_SIGNALS.items())])} AS categories, {ASKED_KIND} AS kind, clean FROM (SELECT *, len(list_filter(string_split_regex(clean, '\s+'), lambda t: trim(t) <> '')) AS n_clean FROM forms) f WHERE f.query IN (SELECT query FROM golden_queries)),
w AS (SELECT id, name AS file_name, concat_ws(' ', lower(metadata_str), lower(content_snip)) AS body, {STEM} AS stem, lower(name) AS raw, lower(extension) AS ext, {WORDS_OF.format(STEM)} AS name_words, {WORDS_OF.format("string_split(path, '/')[-2]")} AS folder_words, {WORDS_OF.format('metadata_str')} AS meta_words, {WORDS_OF.format('content_snip')} AS content_words, {WORDS_OF.format('entities')} AS entity_words FROM latest),
pairs AS (SELECT q.*, w.* FROM (SELECT DISTINCT qid, id FROM hits) h JOIN q ON q.qid = h.qid JOIN w ON w.id = h.id),
p AS (SELECT *, len(list_filter(core, lambda t: {_has('entity_words', 't')})) AS n_entity, CASE WHEN len(name_words) > 0 AND len(core) > 0 THEN len(list_filter(name_words, lambda n: {NAMES_IT})) / len(name_words) ELSE 0 END AS covered,
  list_filter({TOKENS.format("concat_ws(' ', " + EXPANDED + ")")}, lambda t: NOT list_contains(tokens, t)) AS more FROM pairs),
s AS (SELECT qid, id, ext, core, kind, categories, {HINDI_FACTOR} AS by_language, {_total('tokens', TOKEN_POINTS)} + CASE WHEN person AND len(core) > 0 AND len(entity_words) > 0 THEN CASE WHEN n_entity = len(core) THEN {L['person_all']} ELSE n_entity * {L['person_each']} END ELSE 0 END + covered * 80.0 + CASE WHEN covered = 1 THEN 100.0 ELSE 0 END
  + {_total('list_distinct(periods)', f"CASE WHEN {_has('name_words', 't')} OR {_has('meta_words', 't')} THEN {L['period']} ELSE 0 END")}
  + CASE WHEN len(core) < 2 AND len(periods) = 0 THEN {_total(f"list_filter(more, lambda x, i: list_position(more, x) = i)[1:{L['most_synonyms']}]", f"CASE WHEN {_has('name_words', 't')} THEN {L['synonym_name']} ELSE 0 END + CASE WHEN {_has('meta_words', 't')} THEN {L['synonym_metadata']} ELSE 0 END")} ELSE 0 END AS base FROM p),
k AS (SELECT *, CASE WHEN kind = 'audio music' THEN {V.AUDIO!r} WHEN kind = 'video' THEN {V.VIDEO!r} WHEN kind = 'photo image' THEN {V.IMAGES!r} WHEN list_contains(categories, 'MEDIA') AND list_has_any(core, {V.MEDIA_WORDS!r}) THEN {(V.AUDIO + V.VIDEO + V.IMAGES)!r} END AS good, coalesce(kind IN ('audio music', 'video', 'photo image'), FALSE) AS sure FROM s),
scored AS (SELECT qid, id, CASE WHEN base <= 0 THEN 0 ELSE base * by_language * CASE WHEN good IS NULL THEN 1.0 WHEN list_contains(good, ext) THEN CASE WHEN sure THEN {L['type_match']} ELSE {L['media_match']} END WHEN list_contains({V.DOCUMENTS!r}, ext) THEN {L['mismatch']} ELSE 1.0 END END AS score FROM k)"""


@query(f"WITH {LATEST}, {FORMS}, {QTOKENS}, {POSTINGS.replace('JOIN asked a', 'JOIN golden_tokens a')}, {SCORED} SELECT qid, id, round(score, 4) AS score FROM scored WHERE score > 0")
def search_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole score by words of every file that shares a word with a golden query."""
    asked, lib, pairs = _pool(spark, sf_dir)
    asked = asked.withColumn("q", F.col("q").withField("target", F.array().cast("array<string>")))
    return SE.scored(pairs, asked, lib).select("qid", "id", F.round("score", 4).alias("score"))


@query()
def search_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the wanted files of golden queries come in every stage of the search, and why not higher."""
    files = now(spark, sf_dir)
    lib = SE.library(files, table(spark, sf_dir, "fts_index"))
    asked, n = cut(SE.prepared(golden(spark, sf_dir))), R.limits(lib.size)
    vectors = files.select("id", F.col("embedding").alias("v"))
    names, keyed = cut(SE.field_matches(asked, lib, ["name"], n["token"])), cut(SE.keyword_tiers(asked, lib, n["keyword"]))
    own = cut(SE.query_vectors(keyed, vectors))
    dense = cut(R.nearest(own, vectors, n["dense"]))
    results, words, pool = SE.one_pass(asked, lib, names, keyed, dense, vectors, own, 20)
    targets = table(spark, sf_dir, "golden_queries").select(F.col("query").alias("qid"), F.col("expected_substring").alias("hint"))
    return events.verdicts(targets, results, words, dense, SE.candidates(asked, lib, names, keyed), pool, files, n["dense"])


@query(
    f"""WITH {BASE[5:]}, n AS (SELECT qid, id, n_tokens, count(DISTINCT token) AS n FROM hits WHERE field IN ('content', 'metadata', 'entity') GROUP BY qid, id, n_tokens), s AS (SELECT *, sum(CASE WHEN n = n_tokens THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS n_full FROM n),
k AS (SELECT s.qid, s.id, n = n_tokens AS is_full, row_number() OVER (PARTITION BY s.qid ORDER BY n / n_tokens DESC, l.last_modified DESC, s.id) AS ord FROM s JOIN latest l ON l.id = s.id WHERE n = n_tokens OR n_full < 3) SELECT qid, id, CASE WHEN is_full THEN 'strict' ELSE 'relaxed' END AS tier, ord FROM k WHERE ord <= 80"""
)
def search_content_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 80 newest files whose text, description and entities hold all words, or any where few hold all."""
    q = golden(spark, sf_dir)
    asked = q.select("qid", F.struct(F.array(T.tokenize(F.col("query"))).alias("groups")).alias("q"))
    return SE.field_matches(asked, SE.library(now(spark, sf_dir), table(spark, sf_dir, "fts_index")), ["content", "metadata", "entity"], 80)


@query(
    """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS len FROM embeddings),
s AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / q.len / e.len AS score FROM n q, n e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT qid, id, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10"""
)
def search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth, by brute force."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return R.nearest(asked, rows, 11).where("qid <> id").transform(lambda d: R.best(d.drop("place"), 10)).select("qid", "id", F.round("score", 5).alias("score"))


@query(
    """WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.qid, e.vec_id AS id, round(list_sum(list_transform(list_zip(q.q, e.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 5) AS score FROM q, embeddings e), r AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY score DESC) AS rank FROM s)
SELECT qid, id, rank FROM r JOIN embeddings e ON e.vec_id = r.id JOIN embeddings o ON o.vec_id = r.qid WHERE e.label = o.label"""
)
def tracked_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true rank of every vector of a query's own label among all."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("own"))
    labels = asked.select("qid", "own").join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "own").select("qid", "id")
    scored = R.all_scores(asked.select("qid", "q"), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))).withColumn("score", F.round("score", 5))
    return R.rank_of(scored, labels)


@query()
def search_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every different past query asks for."""
    asked = table(spark, sf_dir, "search_completed").select("query").distinct()
    return enrichment.enriched(asked, year=2025).select("query", "stable_order", "time_hint", "type_hint", "action", "target", F.array_join("quarters", ",").alias("quarters"))


ORDER = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(query), '\\b(?:{'|'.join(t for t in ts if ' ' not in t)})\\b')" + "".join(f" OR contains(lower(query), '{t}')" for t in ts if " " in t) + f" THEN '{name}'" for name, ts in V.TIME_HINTS
) + " END"
KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '\\b(?:{'|'.join(ts.split())})\\b') THEN '{name}'" for name, ts in V.TYPE_HINTS) + " END"
ACTION = "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '\\b(?:{a})\\b') THEN '{a}'" for a in V.ACTIONS) + " END"


@query(f"SELECT DISTINCT query, {ORDER} AS time_hint, {KIND} AS type_hint, {ACTION} AS action FROM search_completed WHERE query IS NOT NULL")
def search_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of time, type and action in every different past query."""
    asked = table(spark, sf_dir, "search_completed").where("query IS NOT NULL").select("query").distinct()
    return enrichment.enriched(asked).select("query", "time_hint", "type_hint", "action")


ONCE = "once AS (SELECT * FROM search_completed QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at NULLS LAST, event_ts NULLS LAST) = 1)"


@query(f"WITH {ONCE} SELECT event_id, device_id, query FROM once")
def searches_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search once."""
    return events.once(table(spark, sf_dir, "search_completed")).select("event_id", "device_id", "query")


@query(f"WITH {ONCE} SELECT strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H') AS hour, query, count(*) AS n FROM once GROUP BY ALL")
def searches_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of each query in each hour."""
    found = events.once(table(spark, sf_dir, "search_completed"))
    return found.groupBy(F.date_format(F.date_trunc("hour", "event_ts"), "yyyy-MM-dd HH").alias("hour"), "query").agg(F.count("*").alias("n"))


@query(f"WITH {ONCE} SELECT event_id, query, unnest(generate_series(1, len(CAST(results AS VARCHAR[])))) AS place, unnest(CAST(results AS VARCHAR[])) AS path FROM (SELECT event_id, query, from_json(results, '[\"VARCHAR\"]') AS results FROM once) WHERE len(CAST(results AS VARCHAR[])) > 0")
def shown_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result that a search showed, with its place."""
    return events.shown(events.once(table(spark, sf_dir, "search_completed")))


@query(
    f"""WITH {ONCE}, g AS (SELECT DISTINCT lower(trim(query)) AS key, lower(expected_substring) AS hint, max_shown_rank FROM golden_queries), s AS (SELECT event_id, lower(trim(query)) AS key, coalesce(CAST(from_json(results, '["VARCHAR"]') AS VARCHAR[]), []) AS paths FROM once),
p AS (SELECT g.key, max_shown_rank, list_min(list_filter(generate_series(1, len(paths)), lambda i: contains(lower(paths[i]), hint))) AS place FROM s JOIN g USING (key))
SELECT key AS query, count(*) AS n_searches, min(place) AS best_place, CAST(sum(CASE WHEN place <= max_shown_rank THEN 1 ELSE 0 END) AS BIGINT) AS n_passed FROM p GROUP BY key"""
)
def golden_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often searches for golden queries showed what they should."""
    return events.golden_report(events.once(table(spark, sf_dir, "search_completed")), table(spark, sf_dir, "golden_queries"))


@query(
    f"""WITH {ONCE}, e AS (SELECT device_id, query, event_ts AS ts, 0 AS kind, NULL AS event_id, NULL AS clicked_rank, NULL AS clicked_path, coalesce(results, '[]') AS results FROM once
  UNION ALL SELECT device_id, query, event_ts, 1, event_id, clicked_rank, clicked_path, NULL FROM result_clicked),
l AS (SELECT *, last_value(results IGNORE NULLS) OVER (PARTITION BY device_id, query ORDER BY ts, kind, results NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) AS last FROM e)
SELECT event_id, clicked_rank, nullif(list_position(CAST(from_json(last, '["VARCHAR"]') AS VARCHAR[]), clicked_path), 0) AS shown_place FROM l WHERE kind = 1"""
)
def click_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the search before a click had shown what was clicked."""
    return events.click_ranks(table(spark, sf_dir, "result_clicked"), events.once(table(spark, sf_dir, "search_completed")))


@query(
    f"""WITH {ONCE}, n AS (SELECT *, lead(event_ts) OVER (PARTITION BY device_id ORDER BY event_ts, event_id) AS following FROM once)
SELECT event_id FROM n WHERE following IS NULL OR epoch_us(following) - epoch_us(event_ts) > 800000"""
)
def searches_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that none of the same device followed at once."""
    return events.settled(events.once(table(spark, sf_dir, "search_completed"))).select("event_id")


@query(
    BASE
    + r""", n AS (SELECT h.qid, h.id, h.n_tokens, count(DISTINCT h.token) AS n, any_value(len(f.tokens)) AS size FROM hits h JOIN fields f ON f.id = h.id AND f.field = 'name' WHERE h.field = 'name' GROUP BY h.qid, h.id, h.n_tokens)
SELECT qid, id, round(n / size, 6) AS name_share, round(n / n_tokens, 6) AS query_share, n_tokens >= 2 AND n / size >= 0.85 AND n / n_tokens >= 0.85 AS is_title FROM n"""
)
def name_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each other golden queries and names cover."""
    found = R.coverage(golden(spark, sf_dir), now(spark, sf_dir))
    return found.select("qid", "id", F.round("name_share", 6).alias("name_share"), F.round("query_share", 6).alias("query_share"), "is_title")


@query(
    f"""{BASE}, {LEXICAL}, named AS (SELECT qid, id FROM hits WHERE field = 'name' GROUP BY qid, id, n_tokens HAVING count(DISTINCT token) = n_tokens), scored AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS ord FROM lexical QUALIFY ord <= 100),
u AS (SELECT qid, id, 0 AS tier, CAST(0 AS BIGINT) AS ord, TRUE AS pinned FROM named UNION ALL SELECT qid, id, 1, ord, FALSE FROM scored), o AS (SELECT qid, id, min(tier * 1000000 + ord) AS first, bool_or(pinned) AS pinned FROM u GROUP BY qid, id),
p AS (SELECT qid, id, first // 1000000 AS tier, pinned, row_number() OVER (PARTITION BY qid ORDER BY first, id) AS pos FROM o) SELECT qid, id, CAST(tier AS INT) AS tier, pos FROM p WHERE pos <= 40 OR pinned"""
)
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of golden queries: those with all words in the name, which stay, then the best scored."""
    q, files = golden(spark, sf_dir), now(spark, sf_dir)
    named = R.full_matches(q, files, ["name"]).withColumn("ord", F.lit(0))
    scored = R.best(R.lexical(q, files).withColumn("score", F.round("score", 6)), 100).select("qid", "id", F.col("place").alias("ord"))
    return R.pooled([(named, True), (scored, False)], 40)


@query(f"{BASE}, {LEXICAL}, g AS (SELECT DISTINCT query AS qid FROM golden_queries), per AS (SELECT qid, count(*) AS n, max(score) AS top FROM lexical GROUP BY qid) SELECT g.qid, coalesce(n, 0) AS n, round(coalesce(top, 0.0), 6) AS top FROM g LEFT JOIN per ON per.qid = g.qid WHERE coalesce(top, 0) < 300")
def queries_to_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden queries that found nothing, or nothing good."""
    q = golden(spark, sf_dir)
    return R.weak_queries(q, R.lexical(q, now(spark, sf_dir)), 300.0).select("qid", "n", F.round("top", 6).alias("top"))


#: Aliases of the query below; any others may be given.
ALIASES = {"invoice": ["bill", "rechnung", "facture"], "photo": ["picture", "foto"], "resume": ["cv"], "budget": ["plan"]}


@query(
    f"SELECT DISTINCT query, array_to_string(list_sort(list_distinct(flatten(list_transform({TOKENS.format('query')}, lambda t: list_concat([t], CASE t "
    + " ".join(f"WHEN '{t}' THEN {more!r}" for t, more in ALIASES.items())
    + " ELSE [] END))))), ' ') AS tokens FROM search_completed WHERE query IS NOT NULL"
)
def search_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every different past query, with their aliases."""
    asked = table(spark, sf_dir, "search_completed").where("query IS NOT NULL").select("query").distinct()
    return asked.select("query", F.array_join(F.array_sort(T.expanded(T.tokenize(F.col("query")), ALIASES)), " ").alias("tokens"))
