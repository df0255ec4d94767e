"""Streams: events as they come, and the index kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from korrel.operators.index import KEY, upsert


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The events of JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).json(folder)


def once_in_time(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Every event once, as long as repeats come within ``late``; what was seen is then forgotten."""
    return events.withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["event_id"])


def searches_per_window(events: DataFrame, late: str = "3 days", width: str = "1 hour") -> DataFrame:
    """(window, query, n): searches of each query in each window, closed when it can't change."""
    return events.withWatermark("event_ts", late).groupBy(F.window("event_ts", width), "query").agg(F.count("*").alias("n"))


def keep_index(changed: DataFrame, table: str, checkpoint: str, build) -> StreamingQuery:
    """Fold a stream of changed files into the Parquet table of the index, one batch at a time.

    ``build`` makes index rows of a batch. A version of the table is a folder of its own, named by
    its batch, so a batch that is run again after a loss gives the same result."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = build(batch)
        if batch_id > 0:
            new = upsert(spark.read.parquet(f"{table}/v={batch_id - 1}"), new)
        new.write.mode("overwrite").parquet(f"{table}/v={batch_id}")

    return changed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_of_key(batch: DataFrame) -> DataFrame:
    """Of each file of a batch the row that was modified last."""
    return batch.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in KEY]), "last_modified").alias("r")).select(*KEY, "r.*")
