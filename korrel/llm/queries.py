"""Queries of the operators for language-model data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.llm import knn, language, leakage, mixing, names, pii, sentences
from korrel.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of personal data in the free text and the packed fields of every file."""
    return pii.personal_items(table(spark, sf_dir, "indexed_files"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields with typed placeholders in place of personal data."""
    return pii.redacted_files(table(spark, sf_dir, "indexed_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files of which one is among the ten most similar of the other."""
    return knn.similar_pairs(table(spark, sf_dir, "indexed_files"))


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar files of every file, with their cosine."""
    near = knn.nearest_of_all(table(spark, sf_dir, "indexed_files")).select("id", F.posexplode("near").alias("pos", "x"))
    return near.select("id", (F.col("pos") + 1).alias("place"), F.col("x.neighbour").alias("neighbour"), (1 - F.col("x.away")).cast("double").alias("cosine"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one owner."""
    return names.variant_pairs(table(spark, sf_dir, "indexed_files"))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of an owner with the entity it belongs to."""
    return names.linked_spellings(table(spark, sf_dir, "indexed_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language segments of files whose text is mixed, or its label missing or wrong."""
    return language.mended_labels(table(spark, sf_dir, "indexed_files"), table(spark, sf_dir, "lang_labels"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language segment of every file, with its place and confidence."""
    return language.language_segments(table(spark, sf_dir, "indexed_files"), table(spark, sf_dir, "lang_labels"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation items that each document holds, wholly or partly."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked passages with their places in the documents."""
    return leakage.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix: every use of a document, in the order of the schedule."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p4_found": p4_found, "p4_entities": p4_entities, "p3_found": p3_found, "p3_nearest": p3_nearest, "p5_found": p5_found, "p5_segments": p5_segments, "p6_found": p6_found, "p6_passages": p6_passages, "p7_mix": p7_mix, "p7_report": p7_report, "p8_found": p8_found}
#: Words as the leakage operator compares them. DuckDB has no case folding, so what folding makes of
#: letters in these tables besides lower case is written out.
WORDS = r"""list_filter(list_transform(string_split_regex(trim(text), '\s+'), lambda w: nfc_normalize(regexp_replace(replace(replace(lower(nfc_normalize(w)), 'ß', 'ss'), 'ς', 'σ'), '^[\p{P}\p{S}\p{Z}\p{C}]+|[\p{P}\p{S}\p{Z}\p{C}]+$', '', 'g'))), lambda w: w <> '')"""
RUNS = "SELECT DISTINCT {0}, array_to_string(words[i : i + 11], ' ') AS run FROM (SELECT {0}, words, unnest(generate_series(1, len(words) - 11)) AS i FROM (SELECT {0}, {2} AS words FROM {1}))"
ORACLES: dict[str, str] = {"p6_found": f"SELECT DISTINCT doc_id, item_id FROM ({RUNS.format('doc_id', 'documents', WORDS)}) JOIN ({RUNS.format('item_id', 'eval_items', WORDS)}) USING (run)"}
