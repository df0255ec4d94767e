"""Reading files of a folder tree: their list, and the text of plain and office files."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import files as X

#: Characters of text that are kept, and what is read of an office file at most.
TEXT_CHARS, PART_BYTES = 800, 20_000_000
PLAIN = "txt md csv json html htm py js ts kt java cpp c h".split()
OFFICE = {"docx": r"word/document\.xml", "xlsx": r"xl/sharedStrings\.xml", "pptx": r"ppt/slides/slide\d+\.xml"}


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, extension, size_bytes, last_modified, content) of the indexable files below a
    folder. Content is read only where it is asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.substring_index("path", "/", -1)
    listed = found.select("path", name.alias("name"), X.extension_of(name).alias("extension"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("last_modified"), "content")
    return listed.where(X.is_indexable(F.col("path"), F.col("extension")))


def in_scan_order(listed: DataFrame) -> DataFrame:
    """Files of the folders that matter most first, then by kind, then by path."""
    from korrel.functions.values import EXTENSIONS

    kind = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), F.lower("extension"))
    return listed.orderBy(X.folder_priority(F.col("path")), kind, "path")


def plain_text(content: bytes | None, extension: str) -> str | None:
    """The first characters of a text file; tags of HTML are taken off first."""
    if content is None:
        return None
    text = content[: TEXT_CHARS * 64].decode("utf-8", errors="replace")
    if extension in ("html", "htm"):
        text = html.unescape(re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", text))
    return " ".join(text.split())[:TEXT_CHARS] or None


def office_text(content: bytes | None, extension: str) -> str | None:
    """The first characters of an office file; null if it is no readable archive."""
    if content is None or content[:2] != b"PK":
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            parts = sorted((n for n in z.namelist() if re.fullmatch(OFFICE[extension], n)), key=lambda n: (len(n), n))[:10]
            xml = " ".join(z.open(p).read(PART_BYTES).decode("utf-8", errors="replace") for p in parts)
    except (zipfile.BadZipFile, KeyError, RuntimeError):
        return None
    text = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"<(?:w:tab|w:br|/w:p|/a:p)[^>]*>", " ", xml)))
    return " ".join(text.split())[:TEXT_CHARS] or None


def with_text(listed: DataFrame) -> DataFrame:
    """``listed`` with ``content_raw`` in place of ``content``: the text of files of known kinds, else null."""

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, extensions in batches:
            yield pd.Series([plain_text(c, e) if e in PLAIN else office_text(c, e) if e in OFFICE else None for c, e in zip(contents, extensions)], dtype="object")

    return listed.withColumn("content_raw", read("content", "extension")).drop("content")


def digest(listed: DataFrame) -> DataFrame:
    """(path, sha256) of the files' content."""
    return listed.select("path", F.sha2("content", 256).alias("sha256"))
