"""Queries over the file index: its state, changes, statistics, and what its columns say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import files as X
from korrel.functions import owners as O
from korrel.functions import text as T
from korrel.functions import values as V
from korrel.functions import vectors as VX
from korrel.operators import index as I
from korrel.session import table

#: The time at which ages are taken: 2025-07-15 UTC, in epoch milliseconds.
AS_OF = 1_752_537_600_000

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


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "indexed_files")


def earliest(rows: DataFrame) -> DataFrame:
    """The first row of every file."""
    chosen = rows.groupBy(*I.KEY).agg(F.min(F.struct("indexed_at", "id"))["id"].alias("id"))
    return rows.join(chosen.select("id"), "id", "left_semi")


LATEST = "latest AS (SELECT * FROM indexed_files QUALIFY row_number() OVER (PARTITION BY device_id, path ORDER BY indexed_at DESC, id DESC) = 1)"
EARLIEST = "earliest AS (SELECT * FROM indexed_files QUALIFY row_number() OVER (PARTITION BY device_id, path ORDER BY indexed_at, id) = 1)"
CLASS = f"[^{V.TOKEN_CHARS}\\s]"
TOKENS = "list_filter(string_split_regex(regexp_replace(lower({0}), '" + CLASS + r"', ' ', 'g'), '\s+'), lambda t: length(t) > 1)"
STEM = r"trim(regexp_replace(lower(regexp_replace(name, '\.[^.]*$', '')), '[_\-.]', ' ', 'g'))"


@query("SELECT id, device_id, path, last_modified, size_bytes FROM indexed_files")
def scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored state of every row: only these columns are read."""
    return files(spark, sf_dir).select("id", "device_id", "path", "last_modified", "size_bytes")


@query(f"WITH {LATEST} SELECT id, device_id, path, indexed_at FROM latest")
def index_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of every file."""
    return I.latest(files(spark, sf_dir)).select("id", "device_id", "path", "indexed_at")


DIFF = f"""WITH {LATEST}, {EARLIEST}, diff AS (
  SELECT coalesce(l.device_id, e.device_id) AS device_id, coalesce(l.path, e.path) AS path,
    CASE WHEN l.path IS NULL THEN 'deleted' WHEN e.last_modified IS NULL THEN 'new'
      WHEN e.last_modified = 0 OR e.last_modified <> l.last_modified OR e.size_bytes <> l.size_bytes THEN 'changed' ELSE 'unchanged' END AS status
  FROM latest l FULL OUTER JOIN earliest e ON l.device_id = e.device_id AND l.path = e.path)"""


@query(DIFF + " SELECT device_id, path, status FROM diff")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between the first and the last time a file was seen."""
    rows = files(spark, sf_dir)
    return I.changes(earliest(rows), I.latest(rows))


@query(DIFF + " SELECT status, count(*) AS n FROM diff GROUP BY status")
def index_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of files of each status."""
    return I.change_counts(index_changes(spark, sf_dir))


@query(f"WITH {LATEST}, {EARLIEST} SELECT id FROM latest UNION ALL SELECT e.id FROM earliest e ANTI JOIN latest l ON e.device_id = l.device_id AND e.path = l.path")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of all files with the last ones put in their place."""
    rows = files(spark, sf_dir)
    return I.upsert(earliest(rows), I.latest(rows)).select("id")


@query(f"WITH {LATEST} SELECT id FROM latest l ANTI JOIN fts_index f ON l.device_id = f.device_id AND l.path = f.path")
def index_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left after those with keyword text are taken out: what has none."""
    return I.without(I.latest(files(spark, sf_dir)), table(spark, sf_dir, "fts_index")).select("id")


@query(
    f"""WITH {LATEST}, r AS (SELECT id, CASE WHEN contains(path, '/Download/') THEN replace(path, '/Download/', '/Downloads/') END AS new_path, path, name, extension FROM latest)
SELECT id, coalesce(new_path, path) AS path, CASE WHEN new_path IS NULL THEN name ELSE split_part(new_path, '/', -1) END AS name,
  CASE WHEN new_path IS NULL THEN extension ELSE lower(regexp_extract(split_part(new_path, '/', -1), '\\.([^.]*)$', 1)) END AS extension FROM r"""
)
def index_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a folder was renamed."""
    now = I.latest(files(spark, sf_dir))
    moves = now.where(F.col("path").contains("/Download/")).select(*I.KEY, F.replace("path", F.lit("/Download/"), F.lit("/Downloads/")).alias("new_path"))
    return I.renamed(now.select("id", *I.KEY, "name", "extension"), moves).select("id", "path", "name", "extension")


@query("SELECT id, CAST(0 AS BIGINT) AS last_modified FROM indexed_files")
def index_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index marked to be made anew."""
    return I.forced(files(spark, sf_dir)).select("id", "last_modified")


@query(
    """WITH c AS (SELECT DISTINCT id, unnest(regexp_extract_all(upper(categories), '[A-Z]+')) AS category FROM indexed_files)
SELECT category, count(*) AS n FROM c WHERE category IN ('IDENTITY','WORK','EDUCATION','PERSONAL','MEDIA','GENERAL') GROUP BY category"""
)
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each category; a row counts once in each of its own."""
    from korrel.operators.packed import packed_items

    items = packed_items(files(spark, sf_dir), ["categories"]).select("id", F.explode("items").alias("item"))
    return I.category_counts(items)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE ocr_pending) AS n_pending, count(DISTINCT device_id) AS n_devices FROM indexed_files")
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows that wait for text, and devices."""
    return files(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("ocr_pending").alias("n_pending"), F.count_distinct("device_id").alias("n_devices"))


PRIORITY = "CASE " + " ".join(f"WHEN contains(lower(path), '{d.lower()}') THEN {i}" for i, d in enumerate(V.FIRST_FOLDERS)) + f" ELSE {len(V.FIRST_FOLDERS)} END"


@query(f"WITH {LATEST} SELECT id, device_id, path, {PRIORITY} AS priority FROM latest WHERE ocr_pending AND lower(extension) = 'pdf'")
def pending_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose text is still to be read, with their priority."""
    return I.pending_text(I.latest(files(spark, sf_dir)))


@query(
    f"""WITH {LATEST} SELECT l.id, CASE WHEN trim(f.keywords) <> '' AND (l.content_snip IS NULL OR trim(l.content_snip) = '') THEN f.keywords ELSE l.content_snip END AS content_snip,
  CASE WHEN trim(f.keywords) <> '' THEN FALSE ELSE l.ocr_pending END AS ocr_pending
FROM latest l LEFT JOIN fts_index f ON l.device_id = f.device_id AND l.path = f.path"""
)
def index_read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with text that was read later, where they had none."""
    texts = table(spark, sf_dir, "fts_index").select(*I.KEY, F.col("keywords").alias("ocr_text"))
    return I.with_read_text(I.latest(files(spark, sf_dir)), texts).select("id", "content_snip", "ocr_pending")


AGE = f"CASE {' '.join(f'WHEN d <= {n} THEN {chr(39)}{b}{chr(39)}' for n, b in V.AGE_BUCKETS)} ELSE 'older' END"
SIZE = f"CASE {' '.join(f'WHEN size_bytes < {n} THEN {chr(39)}{b}{chr(39)}' for n, b in V.SIZE_BUCKETS)} ELSE 'huge' END"
TYPE = "CASE " + " ".join(f"WHEN lower(extension) IN ({', '.join(repr(e) for e in k.split())}) THEN '{t}'" for t, k in V.TYPE_LABELS.items()) + " ELSE 'file' END"
DAYS = f"floor(({AS_OF} - last_modified) / 86400000.0)"
FOLDER = "string_split(path, '/')[-2]"


@query(
    f"""SELECT id, {AGE.replace('d <=', DAYS + ' <=')} AS age_bucket, {SIZE} AS size_bucket, {TYPE} AS type_label, CASE WHEN size_bytes < 1024 THEN concat(size_bytes, ' B') WHEN size_bytes < 1048576 THEN concat(size_bytes // 1024, ' KB') ELSE printf('%.1f MB', size_bytes / 1048576.0) END AS shown_size,
  CASE WHEN last_modified <= 0 THEN '' ELSE strftime(make_timestamp(last_modified * 1000), '%-d %b') END AS shown_date, {FOLDER} AS folder FROM indexed_files"""
)
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age, size, kind and folder of every row, and how people read them."""
    return files(spark, sf_dir).select(
        "id", X.age_bucket(F.col("last_modified"), AS_OF).alias("age_bucket"), X.size_bucket(F.col("size_bytes")).alias("size_bucket"), X.type_label(F.col("extension")).alias("type_label"),
        X.display_size(F.col("size_bytes")).alias("shown_size"), X.result_date(F.col("last_modified")).alias("shown_date"), X.parent_folder(F.col("path")).alias("folder"),
    )


@query(
    f"""WITH p AS (SELECT id, path, lower(path) AS low, coalesce({FOLDER}, '') AS folder FROM indexed_files)
SELECT id, CASE {" ".join(f"WHEN contains(low, '{part}') THEN '{source}'" for part, source in V.SOURCES)} WHEN trim(folder) = '' THEN '{V.NO_SOURCE}' ELSE concat(upper(folder[1:1]), folder[2:]) END AS source FROM p"""
)
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every file came from."""
    return files(spark, sf_dir).select("id", X.source_label(F.col("path")).alias("source"))


SKIPPED = " OR ".join(f"contains(path, '{d}')" for d in V.SKIPPED_FOLDERS)


@query(f"SELECT id, {PRIORITY} AS priority FROM indexed_files WHERE NOT ({SKIPPED}) AND lower(extension) IN ({', '.join(repr(e) for e in V.EXTENSIONS)})")
def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of known kinds outside skipped folders, with the priority of their folder."""
    rows = files(spark, sf_dir)
    return rows.where(X.is_indexable(F.col("path"), F.col("extension"))).select("id", X.folder_priority(F.col("path")).alias("priority"))


@query(
    rf"""WITH s AS (SELECT id, regexp_replace(name, '\.[^.]*$', '') AS stem FROM indexed_files), l AS (SELECT id, stem, lower(stem) AS low FROM s)
SELECT id, nullif(regexp_extract(low, '20(2[0-9])'), '') AS year, nullif(regexp_extract(low, '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)'), '') AS month, upper(nullif(regexp_extract(low, 'q[1-4]'), '')) AS quarter,
  nullif(regexp_extract(low, '\b(v\d+|final|draft|old|backup|copy)\b'), '') AS version FROM l"""
)
def name_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, month, quarter and version in file names."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return files(spark, sf_dir).select("id", X.name_signals(stem).alias("s")).select("id", "s.year", "s.month", "s.quarter", "s.version")


@query(
    r"""SELECT id, regexp_matches(lower(content_snip), '(rs\.?|₹|\$|inr)\s*[\d,]+') AS has_amount, regexp_matches(content_snip, '\b[6-9]\d{9}\b') AS has_phone,
  regexp_matches(content_snip, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}') AS has_email, len(regexp_extract_all(content_snip, '\b[A-Z]{5}[0-9]{4}[A-Z]\b')) AS n_ids, len(string_split_regex(content_snip, '\s+')) AS n_words
FROM indexed_files WHERE content_snip IS NOT NULL"""
)
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every snippet holds."""
    rows = files(spark, sf_dir).where("content_snip IS NOT NULL").select("id", X.text_signals(F.col("content_snip")).alias("s"))
    return rows.select("id", "s.has_amount", "s.has_phone", "s.has_email", F.size("s.ids").cast("long").alias("n_ids"), F.col("s.n_words").cast("long").alias("n_words"))


@query(
    r"""SELECT id, content_snip IS NULL OR trim(content_snip) = '' OR length(regexp_replace(content_snip, '[^\p{L}\p{Nd}]', '', 'g')) < 40
  OR len(list_filter(string_split_regex(content_snip, '\s+'), lambda w: length(w) > 2)) < 8 AS weak FROM indexed_files"""
)
def weak_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the text of a row is too poor to index."""
    return files(spark, sf_dir).select("id", X.is_weak_text(F.col("content_snip")).alias("weak"))


def _categories() -> str:
    """The categories of a row of (low_path, ext, folder, tokens), as an array, in SQL."""
    out, pictures = [], V.CATEGORY_OF_EXTENSION[0][2]
    folders = [x for _, _, known in V.CATEGORY_OF_FOLDER for x in known]
    one_of = lambda what, known: f"list_contains({[*known]!r}, {what})"
    for i, (category, words) in enumerate(V.CATEGORY_WORDS.items()):
        kind = " + ".join(
            [f"CASE WHEN {one_of('ext', known)}{'' if k else ' AND NOT ' + one_of('folder', V.PICTURE_FOLDERS)} THEN {w} ELSE 0 END" for k, (of, w, known) in enumerate(V.CATEGORY_OF_EXTENSION) if of == category]
            + ([f"CASE WHEN {one_of('ext', pictures)} AND {one_of('folder', V.PICTURE_FOLDERS)} THEN {V.PICTURES_ARE_PERSONAL} ELSE 0 END"] if category == "PERSONAL" else ["0"])
        )
        place = " + ".join(
            [f"CASE WHEN {one_of('folder', known)} THEN {w} ELSE 0 END" for of, w, known in V.CATEGORY_OF_FOLDER if of == category]
            + ([f"CASE WHEN contains(low_path, '{V.MESSENGER_FOLDER}') AND NOT {one_of('folder', folders)} THEN {V.MESSENGER_IS_PERSONAL} ELSE 0 END"] if category == "PERSONAL" else ["0"])
        )
        said = f"len(list_intersect({words!r}, tokens))"
        out.append(f"{{'s': -({said} + {kind} + {place}), 'o': CASE WHEN {said} > 0 THEN {i} WHEN {kind} > 0 THEN {10 + i if category == 'EDUCATION' else 15} ELSE 20 END, 'n': '{category}'}}")
    best = f"list_transform(list_sort(list_filter([{', '.join(out)}], lambda x: x.s < 0))[1:2], lambda x: x.n)"
    return f"CASE WHEN len({best}) > 0 THEN {best} ELSE ['GENERAL'] END"


KINDS = f"""kinds AS (SELECT *, lower(path) AS low_path, lower(extension) AS ext, lower(coalesce({FOLDER}, '')) AS folder,
  {TOKENS.format("concat_ws(' ', regexp_replace(name, '" + chr(92) + ".[^.]*$', ''), path, coalesce(content_snip, ''))")} AS tokens FROM indexed_files)"""


@query(f"WITH {KINDS} SELECT id, array_to_string({_categories()}, ',') AS categories FROM kinds")
def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that every row's name, path, text, kind and folder speak for."""
    found = X.categories_of(F.col("path"), F.col("name"), F.col("extension"), F.col("content_snip"))
    return files(spark, sf_dir).select("id", F.array_join(found, ",").alias("categories"))


@query(f"WITH {LATEST}, {KINDS}, c AS (SELECT id, {_categories()} AS categories FROM kinds) SELECT l.id FROM latest l JOIN c USING (id) WHERE list_has_any(c.categories, ['IDENTITY', 'WORK'])")
def files_of_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of identity or work."""
    now = I.latest(files(spark, sf_dir))
    return I.in_categories(now.withColumn("categories", X.categories_of(F.col("path"), F.col("name"), F.col("extension"), F.col("content_snip"))), ["IDENTITY", "WORK"]).select("id")


NAMED = r"""nullif(concat_ws(' ', CASE WHEN regexp_matches(low, '^(resume|cv)_') THEN concat(upper(person[1:1]), person[2:]) END, CASE WHEN month IS NOT NULL AND year IS NOT NULL THEN concat_ws(' ', month, year) ELSE coalesce(month, year) END, quarter, 'number ' || number, version || ' version'), '')"""
SCRIPT_NAME = "CASE " + f"WHEN regexp_matches(clean, '[{V.SCRIPTS['devanagari']}]') AND regexp_matches(clean, '[{V.SCRIPTS['latin']}]') THEN 'mixed' " + " ".join(f"WHEN regexp_matches(clean, '[{V.SCRIPTS[s]}]') THEN '{n}'" for s, n in V.LANGUAGE_OF_SCRIPT) + " END"


@query(
    rf"""WITH {KINDS}, c AS (SELECT id, {_categories()} AS categories FROM kinds), r AS (SELECT k.*, lower(c.categories[1]) AS label, {AGE.replace('d <=', DAYS + ' <=')} AS age, {TYPE} AS kind, {FOLDER} AS place, regexp_replace(name, '\.[^.]*$', '') AS stem, lower(regexp_replace(name, '\.[^.]*$', '')) AS low FROM kinds k JOIN c USING (id)),
s AS (SELECT *, trim(regexp_replace(stem, '[_\-.]', ' ', 'g')) AS clean, nullif(regexp_extract(low, '20(2[0-9])'), '') AS year, nullif(regexp_extract(low, '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)'), '') AS month, upper(nullif(regexp_extract(low, 'q[1-4]'), '')) AS quarter,
  nullif(regexp_extract(low, '#?\b(\d{{3,6}})\b', 1), '') AS number, nullif(regexp_extract(low, '\b(v\d+|final|draft|old|backup|copy)\b'), '') AS version, regexp_extract(stem, '^[^_]*_([^_]*)', 1) AS person FROM r)
SELECT id, CASE WHEN list_contains({V.MEDIA_EXTENSIONS!r}, ext) THEN concat_ws(' ', CASE WHEN trim(content_snip) <> '' THEN trim(content_snip) END, nullif(trim({NAMED}), ''), CASE WHEN regexp_matches(label, '^[aeiou]') THEN 'An' ELSE 'A' END, label, kind, 'file named', clean, 'in', place, 'folder modified', replace(age, '-', ' '))[1:400]
  ELSE concat_ws(' ', CASE WHEN trim(content_snip) <> '' THEN trim(content_snip) END, nullif(trim({NAMED}), ''), CASE WHEN regexp_matches(label, '^[aeiou]') THEN 'An' ELSE 'A' END, label, kind, 'named', clean, 'in ' || ({SCRIPT_NAME}), 'last modified', replace(age, '-', ' '), 'stored in', place)[1:400] END AS sentence FROM s"""
)
def described_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that describes every row, with its whole text."""
    stem, folder, age = F.regexp_replace("name", r"\.[^.]*$", ""), X.parent_folder(F.col("path")), X.age_bucket(F.col("last_modified"), AS_OF)
    category = F.get(X.categories_of(F.col("path"), F.col("name"), F.col("extension"), F.col("content_snip")), 0)
    parts = (stem, F.col("content_snip"), category, F.col("extension"), age, folder)
    return files(spark, sf_dir).select("id", F.when(F.lower("extension").isin(V.MEDIA_EXTENSIONS), X.media_sentence(*parts)).otherwise(X.document_sentence(*parts)).alias("sentence"))


@query()
def file_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owners and parties that every file's name and text tell."""
    made = I.described(files(spark, sf_dir), AS_OF)
    return made.select("id", O.owners_to_json(F.col("owners")).alias("owners"), F.array_join("entities", " ").alias("entities"), "owner_confidence", "sentence")


@query()
def keyword_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword text of every file, made anew."""
    return I.keyword_texts(I.described(I.latest(files(spark, sf_dir)), AS_OF))


@query(
    r"""WITH t AS (SELECT *, length(regexp_replace(content_snip, '[^\p{L}\p{Nd}]', '', 'g')) AS solid, len(list_filter(string_split_regex(content_snip, '\s+'), lambda w: length(w) > 2)) AS n_long, lower(path) AS low FROM indexed_files)
SELECT id, content_snip IS NULL OR trim(content_snip) = '' OR solid < 30 AS weak_reading, NOT (contains(low, '/dcim/') OR contains(low, '/camera/') OR contains(low, '/pictures/')) AS no_photo,
  size_bytes <= 52428800 AND (content_snip IS NULL OR trim(content_snip) = '' OR solid < 40 OR n_long < 8) AND NOT (contains(low, '/dcim/') OR contains(low, '/camera/') OR contains(low, '/pictures/')) AS to_read FROM t WHERE lower(extension) = 'pdf'"""
)
def texts_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents' texts are to be read from their images (each taken for one page, not encrypted)."""
    rows = files(spark, sf_dir).where(F.lower("extension") == "pdf")
    snippet, path = F.col("content_snip"), F.col("path")
    return rows.select("id", X.is_weak_reading(snippet).alias("weak_reading"), X.is_no_photo(path).alias("no_photo"), X.needs_reading(snippet, path, F.col("size_bytes"), F.lit(1), F.lit(False)).alias("to_read"))


@query(
    rf"""WITH s AS (SELECT id, size_bytes, lower(regexp_replace(name, '\.[^.]*$', '')) AS low, ({AS_OF} - indexed_at) // 60000 AS m, indexed_at, content_snip FROM indexed_files)
SELECT id, CASE WHEN size_bytes < 1024 THEN concat(size_bytes, 'B') WHEN size_bytes < 1048576 THEN concat(size_bytes // 1024, 'KB') ELSE printf('%.1fMB', size_bytes / 1048576.0) END AS size,
  concat_ws(',', CASE WHEN regexp_matches(low, '\d{{4}}') THEN 'dated' END, CASE WHEN regexp_matches(low, 'v\d|final|draft') THEN 'versioned' END, CASE WHEN low = upper(low) AND length(low) > 3 THEN 'important' END, CASE WHEN regexp_matches(low, '(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)') THEN 'monthly' END, CASE WHEN regexp_matches(low, 'q[1-4]|quarter') THEN 'quarterly' END) AS marks,
  CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN concat(m, ' min ago') WHEN m < 1440 THEN concat(m // 60, ' hr ago') WHEN m < 2880 THEN 'yesterday' WHEN m < 10080 THEN concat(m // 1440, ' days ago') WHEN indexed_at <= 0 THEN '' ELSE strftime(make_timestamp(indexed_at * 1000), '%-d %b') END AS age,
  coalesce(length(array_to_string(list_filter(list_transform(string_split(content_snip, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '')) >= 24 OR len(list_filter(string_split(content_snip, chr(10)), lambda x: trim(x) <> '')) >= 2, FALSE) AS telling FROM s"""
)
def file_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How lists of files say size, kind of name and age, and whether there is text to show."""
    return files(spark, sf_dir).select(
        "id", X.compact_size(F.col("size_bytes")).alias("size"), F.array_join(X.name_marks(F.regexp_replace("name", r"\.[^.]*$", "")), ",").alias("marks"),
        X.age_in_words(F.col("indexed_at"), AS_OF).alias("age"), X.is_telling(F.col("content_snip")).alias("telling"),
    )


@query(f"SELECT id, list_sort(list_distinct({TOKENS.format('metadata_str')})) AS tokens FROM indexed_files")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different tokens of every description."""
    return files(spark, sf_dir).select("id", F.array_sort(F.array_distinct(T.tokenize(F.col("metadata_str")))).alias("tokens"))


@query(rf"SELECT id, {STEM} AS stem, len(list_filter(string_split_regex({STEM}, '\s+'), lambda t: trim(t) <> '')) AS n_tokens FROM indexed_files")
def name_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every name, and its number of words."""
    stem = T.stem_of(F.col("name"))
    return files(spark, sf_dir).select("id", stem.alias("stem"), F.size(T.stem_tokens(stem)).cast("long").alias("n_tokens"))


STOPS = "[" + ", ".join(repr(w) for w in V.STOP_WORDS) + "]"


@query(
    rf"""SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9ऀ-ॿ؀-ۿ\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 2 AND NOT list_contains({STOPS}, t)))) AS words FROM documents"""
)
def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All different content words of every document, in order."""
    found = F.split(T.keywords(F.col("text"), 1_000_000), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.filter(found, lambda w: w != "")).alias("words"))


SCRIPT_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '[{r}]') THEN '{s}' END" for s, r in V.SCRIPTS.items()) + "], lambda s: s IS NOT NULL)"


@query(
    f"""SELECT doc_id, array_to_string({SCRIPT_LIST}, ',') AS scripts, CASE WHEN regexp_matches(text, '[{V.SCRIPTS['devanagari']}]') AND regexp_matches(text, '[{V.SCRIPTS['latin']}]') THEN 'mixed' """
    + " ".join(f"WHEN regexp_matches(text, '[{V.SCRIPTS[s]}]') THEN '{name}'" for s, name in V.LANGUAGE_OF_SCRIPT)
    + " END AS language FROM documents"
)
def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts of every document, and the language they suggest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.scripts_of(F.col("text")), ",").alias("scripts"), T.dominant_language(F.col("text")).alias("language"))


@query(
    """SELECT id, len(o) AS n_owners, round(CAST(coalesce(list_max(list_transform(list_filter(o, lambda x: x.role = 'PRIMARY'), lambda x: x.confidence)), 0) AS DOUBLE), 4) AS primary_confidence
FROM (SELECT id, CAST(from_json(owner_names, '[{"tokens":["VARCHAR"],"role":"VARCHAR","confidence":"DOUBLE"}]') AS STRUCT(tokens VARCHAR[], role VARCHAR, confidence DOUBLE)[]) AS o FROM indexed_files WHERE starts_with(owner_names, '[{'))"""
)
def owner_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners stored as JSON: how many, and how sure the first is."""
    rows = files(spark, sf_dir).where(F.col("owner_names").startswith("[{"))
    owners = F.from_json("owner_names", "array<struct<tokens:array<string>,role:string,confidence:double>>")
    first = F.array_max(F.transform(F.filter(owners, lambda x: x["role"] == "PRIMARY"), lambda x: x["confidence"]))
    return rows.select("id", F.size(owners).cast("long").alias("n_owners"), F.round(F.coalesce(first, F.lit(0.0)), 4).alias("primary_confidence"))


@query("SELECT id, sha256(concat_ws('|', '5', path, CAST(last_modified AS VARCHAR))) AS cache_key FROM indexed_files")
def preview_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which a preview of each row is kept."""
    return files(spark, sf_dir).select("id", F.sha2(F.concat_ws("|", F.lit("5"), "path", F.col("last_modified").cast("string")), 256).alias("cache_key"))


@query("SELECT id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS length FROM indexed_files WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: isnan(x))) = 0")
def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every usable vector."""
    return files(spark, sf_dir).where(VX.usable(F.col("embedding"))).select("id", F.round(VX.norm(F.col("embedding")), 4).alias("length"))


@query(
    """WITH q AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label), s AS (
  SELECT e.vec_id, q.label, greatest(-1, least(1, list_sum(list_transform(list_zip(a.embedding, e.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])))) AS cos FROM q JOIN embeddings a ON a.vec_id = q.first JOIN embeddings e ON e.label = q.label)
SELECT label, round(avg(cos), 5) AS mean_cosine, round(min(cos), 5) AS least_cosine FROM s GROUP BY label"""
)
def vector_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the vectors of a label are to its first: mean and least cosine."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    near = rows.join(first, "label").select("label", VX.cosine(F.col("q"), F.col("embedding")).alias("cos"))
    return near.groupBy("label").agg(F.round(F.avg("cos"), 5).alias("mean_cosine"), F.round(F.min("cos"), 5).alias("least_cosine"))


@query(f"WITH {LATEST} SELECT device_id, {TYPE} AS kind, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM latest GROUP BY ALL")
def storage_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each kind on each device."""
    now = I.latest(files(spark, sf_dir))
    return now.groupBy("device_id", X.type_label(F.col("extension")).alias("kind")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query(f"WITH {LATEST} SELECT id, path, last_modified FROM latest ORDER BY last_modified DESC, path, id LIMIT 800")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files modified last."""
    return I.latest(files(spark, sf_dir)).select("id", "path", "last_modified").orderBy(F.desc("last_modified"), "path", "id").limit(800)
