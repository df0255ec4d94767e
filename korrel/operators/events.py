"""The log of searches and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korrel.functions import values as V


def once(events: DataFrame) -> DataFrame:
    """Every event once: of repeated deliveries the one received first (null last)."""
    order = W.partitionBy("event_id").orderBy(F.asc_nulls_last("received_at"), F.asc_nulls_last("event_ts"))
    return events.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def shown(searches: DataFrame) -> DataFrame:
    """(event_id, query, place, path): the results that searches showed, ``place`` from 1."""
    paths = F.from_json("results", "array<string>")
    return searches.select("event_id", "query", F.posexplode(paths).alias("i", "path")).select("event_id", "query", (F.col("i") + 1).alias("place"), "path")


def golden_report(searches: DataFrame, golden: DataFrame) -> DataFrame:
    """(query, n_searches, best_place, n_passed): how often searches for golden queries showed what
    they should, high enough. Queries are compared trimmed and in small letters."""
    key = F.lower(F.trim("query"))
    wanted = golden.select(key.alias("key"), F.lower("expected_substring").alias("hint"), "max_shown_rank").distinct()
    asked = searches.select("event_id", key.alias("key"), F.transform(F.coalesce(F.from_json("results", "array<string>"), F.array().cast("array<string>")), lambda p: F.lower(p)).alias("paths"))
    both = asked.join(wanted, "key")
    places = F.filter(F.transform("paths", lambda p, i: F.when(p.contains(F.col("hint")), i + 1)), lambda x: x.isNotNull())
    placed = both.select("key", "max_shown_rank", F.get(places, 0).alias("place"))
    return placed.groupBy(F.col("key").alias("query")).agg(F.count("*").alias("n_searches"), F.min("place").alias("best_place"), F.sum(F.when(F.col("place") <= F.col("max_shown_rank"), 1).otherwise(0)).alias("n_passed"))


def click_ranks(clicks: DataFrame, searches: DataFrame) -> DataFrame:
    """(event_id, clicked_rank, shown_place): where the last earlier search of the same device for
    the same query showed what was clicked; null if it didn't. Both kinds of events run through one
    window in the order of time, so a click meets the last search only, not all before it."""
    asked = searches.select("device_id", "query", F.col("event_ts").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("int").alias("clicked_rank"), F.lit(None).cast("string").alias("clicked_path"), F.coalesce("results", F.lit("[]")).alias("results"))
    clicked = clicks.select("device_id", "query", F.col("event_ts").alias("ts"), F.lit(1).alias("kind"), "event_id", "clicked_rank", "clicked_path", F.lit(None).cast("string").alias("results"))
    before = W.partitionBy("device_id", "query").orderBy("ts", "kind", "results", "event_id")
    last = asked.unionByName(clicked).withColumn("last", F.last("results", ignorenulls=True).over(before)).where("kind = 1")
    place = F.array_position(F.from_json("last", "array<string>"), F.col("clicked_path"))
    return last.select("event_id", "clicked_rank", F.when(place > 0, place).alias("shown_place"))


def settled(searches: DataFrame, pause_ms: int = 800) -> DataFrame:
    """Searches that no later one of the same device followed within a pause: what was really asked. Each
    device is cut into hours; an hour also sees what begins within a pause after it."""
    micros, hour, pause = F.unix_micros(F.col("event_ts").cast("timestamp")), 3_600_000_000, pause_ms * 1000
    own = searches.withColumn("_us", micros).withColumn("_hour", F.floor(F.col("_us") / hour)).withColumn("_here", F.lit(True))
    after = own.where(F.pmod(F.col("_us"), F.lit(hour)) <= pause).select("device_id", "event_id", "_us", (F.col("_hour") - 1).alias("_hour"), F.lit(False).alias("_here"))
    following = F.lead("_us").over(W.partitionBy("device_id", "_hour").orderBy("_us", "event_id"))
    seen = own.unionByName(after, allowMissingColumns=True).withColumn("_gap", following - F.col("_us"))
    return seen.where(F.col("_here") & (F.col("_gap").isNull() | (F.col("_gap") > pause))).drop("_gap", "_here", "_hour", "_us")


def verdicts(targets: DataFrame, results: DataFrame, words: DataFrame, dense: DataFrame, pool: DataFrame, fused: DataFrame, files: DataFrame, dense_most: int) -> DataFrame:
    """(qid, hint, ...): for each wanted (qid, hint) its best places in every stage of a search, whether it
    was a candidate and in the fused pool, and a verdict: the first of ``V.VERDICTS`` that fits."""
    found = files.select("id", F.lower("path").alias("low")).join(F.broadcast(targets.select("hint").distinct()), F.expr("contains(low, lower(hint))")).select("hint", "id")
    wanted = targets.select("qid", "hint").distinct()

    def best(stage: DataFrame, name: str) -> DataFrame:
        return wanted.join(found, "hint").join(stage.select("qid", "id", "place"), ["qid", "id"]).groupBy("qid", "hint").agg(F.min("place").alias(name))

    out = wanted
    for stage, name in ((results, "shown_place"), (words, "lexical_place"), (dense, "dense_place"), (pool.withColumn("place", F.lit(1)), "in_pool"), (fused.withColumn("place", F.lit(1)), "in_fused")):
        out = out.join(best(stage, name), ["qid", "hint"], "left")
    out = out.withColumns({"in_pool": F.col("in_pool").isNotNull(), "in_fused": F.col("in_fused").isNotNull()})
    shown, near = F.col("shown_place"), F.col("dense_place")
    verdict = (
        F.when(shown == 1, V.VERDICTS[0]).when(shown.between(2, 10), V.VERDICTS[1]).when(near > dense_most, V.VERDICTS[2])
        .when(~F.col("in_pool") & F.col("lexical_place").isNull(), V.VERDICTS[3]).when(near.isNull(), V.VERDICTS[4]).otherwise(V.VERDICTS[5])
    )
    return out.withColumn("verdict", verdict)
