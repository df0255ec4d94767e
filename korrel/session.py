"""Session helpers: reading tables, cutting lineage, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds at least one row in HOT_SHARE; so there are at most HOT_SHARE hot keys,
#: whatever the size of the data, and a table of them may be broadcast.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder of ``spark.checkpoint.dir``. Only a local session (tests,
    one machine) may leave that unset and gets a folder of its own; on a cluster it is an error."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="korrel-"))
    return df.checkpoint(eager=True)


def lookup(facts: DataFrame, entries: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """Join ``facts`` with ``entries`` (one row per key) without a hot partition.

    ``entries.count`` holds how many facts have the key. Keys with more than one fact in
    ``HOT_SHARE`` are at most ``HOT_SHARE`` many and are broadcast; all others take the shuffle,
    where none can be hot. The column ``count`` does not come out.
    """
    total = entries.agg(F.coalesce(F.sum(count), F.lit(0)).alias("_total"))
    marked = entries.crossJoin(F.broadcast(total)).withColumn("_hot", F.col(count) * HOT_SHARE > F.col("_total")).drop("_total", count)
    marked = cut(marked)
    hot = marked.where("_hot").drop("_hot")
    cold = marked.where("NOT _hot").drop("_hot")
    hot_keys = F.broadcast(hot.select(*keys))
    facts_hot = facts.join(F.broadcast(hot), keys, "inner")
    facts_cold = facts.join(hot_keys, keys, "left_anti").join(cold, keys, how)
    return facts_hot.unionByName(facts_cold)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_korrel_shipped", False):
        return spark
    folder = Path(tempfile.mkdtemp(prefix="korrel-code-"))
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(folder / "korrel.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    context.addPyFile(str(folder / "korrel.zip"))
    context._korrel_shipped = True
    return spark
