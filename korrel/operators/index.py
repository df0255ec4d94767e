"""The file index as a table: its current state, changes, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.functions import files as X
from korrel.functions import forms as Q
from korrel.functions import owners as O
from korrel.functions import values as V

KEY = ["device_id", "path"]


def latest(files: DataFrame) -> DataFrame:
    """The current row of every file: of its rows the one indexed last, of those the largest id.
    Only keys, times and ids are shuffled for the choice, not whole rows."""
    chosen = files.groupBy(*KEY).agg(F.max(F.struct("indexed_at", "id"))["id"].alias("id"))
    return files.join(chosen.select("id"), "id", "left_semi")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of the same file."""
    return stored.join(new.select(*KEY).distinct(), KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def without(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """``stored`` without the files of ``gone``."""
    return stored.join(gone.select(*KEY).distinct(), KEY, "left_anti")


def renamed(stored: DataFrame, moves: DataFrame) -> DataFrame:
    """``stored`` with the paths (and names and extensions) of (device_id, path, new_path) changed."""
    moved = stored.join(moves, KEY, "left")
    new = F.coalesce("new_path", "path")
    name = F.substring_index(new, "/", -1)
    return moved.withColumns({"name": F.when(F.col("new_path").isNotNull(), name).otherwise(F.col("name")), "extension": F.when(F.col("new_path").isNotNull(), X.extension_of(name)).otherwise(F.col("extension")), "path": new}).drop("new_path")


def forced(stored: DataFrame) -> DataFrame:
    """``stored`` marked so that every file counts as changed."""
    return stored.withColumn("last_modified", F.lit(0).cast("long"))


def changes(stored: DataFrame, seen: DataFrame, force: bool = False) -> DataFrame:
    """(device_id, path, status) from (device_id, path, last_modified, size_bytes) of what is stored
    and what is seen now: new, changed, unchanged or deleted. A stored time of 0 counts as changed."""
    old = stored.select(*KEY, F.col("last_modified").alias("old_time"), F.col("size_bytes").alias("old_size"))
    both = seen.select(*KEY, "last_modified", "size_bytes").withColumn("here", F.lit(True)).join(old, KEY, "full_outer")
    differs = F.lit(force) | (F.col("old_time") == 0) | (F.col("old_time") != F.col("last_modified")) | (F.col("old_size") != F.col("size_bytes"))
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("old_time").isNull(), "new").when(differs, "changed").otherwise("unchanged")
    return both.select(*KEY, status.alias("status"))


def change_counts(diff: DataFrame) -> DataFrame:
    """(status, n) of a table of changes."""
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def category_counts(values: DataFrame) -> DataFrame:
    """(category, n) from (id, item) of single categories: a file counts once in each of its categories."""
    return values.select("id", F.upper(F.trim("item")).alias("category")).where(F.col("category").isin(V.CATEGORIES)).distinct().groupBy("category").agg(F.count("*").alias("n"))


def pending_text(files: DataFrame) -> DataFrame:
    """Files whose text is still to be read from images, in the order in which to do so."""
    wait = files.where(F.col("ocr_pending") & (F.lower("extension") == "pdf"))
    return wait.select("id", "device_id", "path", X.folder_priority(F.col("path")).alias("priority")).orderBy("priority", "path", "id")


def with_read_text(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``files`` with the text of (device_id, path, ocr_text) where they have none, no longer pending."""
    joined = files.join(texts, KEY, "left")
    got = F.col("ocr_text").isNotNull() & (F.trim("ocr_text") != "")
    return joined.withColumns({"content_snip": F.when(got & (F.col("content_snip").isNull() | (F.trim("content_snip") == "")), F.col("ocr_text")).otherwise(F.col("content_snip")), "ocr_pending": F.when(got, False).otherwise(F.col("ocr_pending"))}).drop("ocr_text")


def described(files: DataFrame, as_of_ms: int) -> DataFrame:
    """The description of every file, made anew from its path, size, time and text: its buckets, kind,
    categories, owners, parties, and the sentence for embedding, in which names of parties are left
    out of the text."""
    folder, stem, ext = X.parent_folder(F.col("path")), F.regexp_replace("name", r"\.[^.]*$", ""), F.lower("extension")
    made = files.select(
        "id", *KEY, "name", "extension", "content_snip", X.age_bucket(F.col("last_modified"), as_of_ms).alias("age_bucket"), X.size_bucket(F.col("size_bytes")).alias("size_bucket"),
        X.type_label(F.col("extension")).alias("type_label"), X.categories_of(F.col("path"), F.col("name"), F.col("extension"), F.col("content_snip")).alias("categories"),
        O.owners_of(stem, F.col("content_snip")).alias("owners"), folder.alias("folder"), stem.alias("stem"),
    )
    made = made.withColumn("entities", O.entities_of(F.col("content_snip"), F.col("owners"))).withColumn("owner_confidence", O.surest(F.col("owners")))
    parts = (F.col("stem"), O.without_entities(F.col("content_snip"), F.col("entities")), F.get("categories", 0), F.col("extension"), F.col("age_bucket"), F.col("folder"))
    return made.withColumn("sentence", F.when(ext.isin(V.MEDIA_EXTENSIONS), X.media_sentence(*parts)).otherwise(X.document_sentence(*parts)))


def keyword_texts(made: DataFrame) -> DataFrame:
    """(device_id, path, keywords) of described files: what a search by keywords reads. ``author`` and
    other values of a document's own properties come in as ``properties`` if there is such a column."""
    signals = X.name_signals(F.col("stem"))
    own = [F.array_join("properties", " ")] if "properties" in made.columns else []
    entities = F.array_join(F.flatten(F.transform("entities", lambda e: F.array(F.concat(F.lit("entity:"), e), e))), " ")
    parts = [
        F.regexp_replace("stem", r"[_\-.]", " "), F.lower("extension"), F.col("folder"), F.lower(F.array_join("categories", " ")), F.col("content_snip"), F.col("type_label"),
        signals["person"], F.array_join(O.owner_tokens(F.col("owners")), " "), F.array_join(O.owner_tokens(F.col("owners"), False), " "), entities,
        signals["month"], signals["year"], signals["quarter"], signals["number"], signals["version"], *own, Q.index_extras(F.col("stem"), F.col("content_snip")),
    ]
    return made.select(*KEY, F.concat_ws(" ", *[F.when(F.trim(p) != "", p) for p in parts]).alias("keywords"))


def in_categories(files: DataFrame, wanted: list[str], most: int | None = None) -> DataFrame:
    """Files (with an array ``categories``) of any of the wanted categories, the newest first."""
    found = files.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in wanted]))).orderBy(F.desc("last_modified"), "path", "id")
    return found.limit(most) if most is not None else found


def without_blank(made: DataFrame) -> DataFrame:
    """Described files that have a sentence to embed."""
    return made.where(F.trim("sentence") != "")
