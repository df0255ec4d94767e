"""Retrieval of files for a set of queries: tokens, BM25, lexical scores, vectors, rank fusion.

``queries`` always is (qid, query). Query sets are small beside the index; each join with one checks
nothing but equality of tokens, so that it is a hash join, broadcast only where Spark's own size
check allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korrel.functions import text as T
from korrel.functions import values as V


#: Query vectors that are sent to the executors at once.
QUERY_BLOCK = 4096


def query_tokens(queries: DataFrame) -> DataFrame:
    """(qid, n_tokens, token): the different tokens of every query."""
    tokens = queries.select("qid", F.array_distinct(T.tokenize(F.col("query"))).alias("tokens"))
    return tokens.select("qid", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))


def postings(files: DataFrame) -> DataFrame:
    """(id, field, token): the different tokens of a file's name, content, description, entities,
    folder and extension."""
    fields = {
        "name": T.stem_tokens(T.stem_of(F.col("name"))), "content": T.tokenize(F.coalesce("content_snip", F.lit(""))), "metadata": T.tokenize(F.coalesce("metadata_str", F.lit(""))),
        "entity": T.tokenize(F.coalesce("entities", F.lit(""))), "extension": F.array(F.lower("extension")),
    }
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(t).alias("tokens")) for f, t in fields.items()])).alias("c")
    return files.select("id", cells).select("id", "c.field", F.explode("c.tokens").alias("token")).where("token IS NOT NULL")


def hits(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, n_tokens, id, field, token): the query tokens that files hold. Files are cut down to the
    asked tokens where they are read, so that only what is found is shuffled."""
    asked = query_tokens(queries)
    return postings(files).join(asked.select("token").distinct(), "token", "left_semi").join(asked, "token")


def full_matches(queries: DataFrame, files: DataFrame, fields: list[str]) -> DataFrame:
    """(qid, id): files that hold every token of a query in the fields, taken together."""
    found = hits(queries, files).where(F.col("field").isin(fields))
    return found.groupBy("qid", "id", "n_tokens").agg(F.count_distinct("token").alias("n")).where("n = n_tokens").select("qid", "id")


def tiered_matches(queries: DataFrame, files: DataFrame, enough: int = 3) -> DataFrame:
    """(qid, id, tier): files by name. Those with all tokens, if at least ``enough``; else those with any."""
    found = hits(queries, files).where("field = 'name'").groupBy("qid", "id", "n_tokens").agg(F.count_distinct("token").alias("n"))
    strict = found.groupBy("qid").agg(F.sum(F.when(F.col("n") == F.col("n_tokens"), 1).otherwise(0)).alias("n_strict"))
    both = found.join(strict, "qid")
    return both.where((F.col("n_strict") < enough) | (F.col("n") == F.col("n_tokens"))).select("qid", "id", F.when(F.col("n") == F.col("n_tokens"), "strict").otherwise("relaxed").alias("tier"))


def best(scored: DataFrame, most: int, by: str = "qid") -> DataFrame:
    """``scored`` (with score and id) cut to the ``most`` best of each query, with ``place`` from 1.
    Spark keeps only that many of each query in every task before the shuffle."""
    order = W.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def bm25_terms(tokens: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, token, weight): what each of (token) weighs in the documents that hold it."""
    counted = docs.select(F.col(id).alias("id"), T.tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).where("size(tokens) > 0")
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("mean_len"))
    terms = counted.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("token")).join(tokens, "token", "left_semi")
    tf = terms.groupBy("id", "token", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    k1, b = V.BM25_K1, V.BM25_B
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    return tf.join(df, "token").crossJoin(F.broadcast(stats)).select("id", "token", weight.alias("weight"))  # one row of statistics


def bm25(queries: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame:
    """(qid, id, score) of the documents that hold any token of a query."""
    asked = query_tokens(queries).select("qid", "token")
    return bm25_terms(asked.select("token").distinct(), docs, id, text).join(asked, "token").groupBy("qid", "id").agg(F.sum("weight").alias("score"))


def store_postings(files: DataFrame, folder: str, buckets: int = 256) -> None:
    """Write the postings of files as a table in which a token's rows lie in one folder by its hash, sorted
    by token, in as many files as hot tokens need."""
    own = postings(files).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    own = own.repartition(F.col("bucket"), F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "token", "id")
    own.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def stored_postings(queries: DataFrame, folder: str, tokens: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """(id, field, token) of a stored table for the tokens of queries: only their folders are read. ``tokens``
    are those to read, else the queries' own (a stated set)."""
    spark = queries.sparkSession
    wanted = sorted(tokens if tokens is not None else {r.token for r in query_tokens(queries).select("token").distinct().collect()})
    rows = spark.read.parquet(folder)
    if not wanted:
        return rows.where("false").select("id", "field", "token")
    where = [r.b for r in spark.createDataFrame([(t,) for t in wanted], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]
    return rows.where(F.col("bucket").isin(where) & F.col("token").isin(wanted)).select("id", "field", "token")


def lexical(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, id, score): the weighted fields in which files hold query tokens, and how much of the
    name the query covers."""
    w = V.WEIGHTS
    found = hits(queries, files)
    weight = F.when(F.col("field") == "name", w["name_exact"]).when(F.col("field") == "extension", w["extension"]).when(F.col("field") == "content", w["content"]).when(F.col("field") == "metadata", w["metadata"]).otherwise(w["entity"])
    names = files.select("id", F.size(F.array_distinct(T.stem_tokens(T.stem_of(F.col("name"))))).alias("name_size"))
    summed = found.groupBy("qid", "id", "n_tokens").agg(F.sum(weight).alias("fields"), F.count_distinct(F.when(F.col("field") == "name", F.col("token"))).alias("in_name"))
    covered = F.col("in_name") / F.greatest(F.col("name_size"), F.lit(1)) * w["coverage"] + F.when((F.col("in_name") == F.col("n_tokens")) & (F.col("in_name") > 0), w["full_coverage"]).otherwise(0.0)
    return summed.join(names, "id").select("qid", "id", (F.col("fields") + covered).alias("score"))


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, rows they are in) of the usable vectors of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    rows = np.nonzero(sized)[0]
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    length = np.linalg.norm(x, axis=1)
    good = np.isfinite(length) & (length > 1e-8)
    return x[good] / length[good, None], rows[good]


def _scanned(queries: DataFrame, vectors: DataFrame, most: int | None) -> DataFrame:
    """(qid, id, score): the cosines of all (id, v), or of at least the ``most`` nearest of each task, to
    each of (qid, q). The queries, a stated set, are read and sent QUERY_BLOCK at a time, so that
    what the driver holds stays bounded; each task multiplies whole blocks."""
    spark, schema, out = queries.sparkSession, f"qid {dict(queries.dtypes)['qid']}, id bigint, score double", None
    stated = queries.where("q IS NOT NULL").select("qid", "q", F.size("q").alias("dims"))
    sizes = {r.dims: r["count"] for r in stated.groupBy("dims").count().collect()}
    for dims, n in sorted(sizes.items()):
        blocks = -(-n // QUERY_BLOCK)
        for k in range(blocks):
            part = stated.where(F.col("dims") == dims)
            part = (part if blocks == 1 else part.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)).orderBy("qid").toArrow()
            matrix, rows = _matrix(part["q"], dims)
            sent = spark.sparkContext.broadcast((matrix, part["qid"].take(pa.array(rows)).combine_chunks(), dims))

            def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                matrix, qids, dims = sent.value
                for b in batches:
                    x, rows = _matrix(b.column("v"), dims)
                    if not len(x) or not len(matrix):
                        continue
                    scores = np.clip(matrix @ x.T, -1.0, 1.0)
                    least = -min(most if most is not None else scores.shape[1], scores.shape[1])
                    q, i = np.nonzero(scores >= np.partition(scores, least, axis=1)[:, least, None])
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), b.column("id").take(pa.array(rows[i])).cast(pa.int64()), pa.array(scores[q, i])], names=["qid", "id", "score"])

            found = vectors.select(F.col("id").cast("long"), "v").mapInArrow(scan, schema)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def nearest(queries: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(qid, id, score, place): the nearest of (id, v) to each of (qid, q) by cosine. Vectors with null
    or NaN, of zeros only or of another length than the query's are near to nothing."""
    return best(_scanned(queries, vectors, most), most)


def all_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, id, score): the cosines of all usable (id, v) of the same length to each of (qid, q)."""
    return _scanned(queries, vectors, None)


def fused(lists: list[tuple[DataFrame, float]], most: int, k: float = V.FUSION["k"]) -> DataFrame:
    """(qid, id, score, place): reciprocal ranks of ranked lists (qid, id, place), weighted and summed."""
    union = None
    for ranked, weight in lists:
        part = ranked.select("qid", "id", (F.lit(weight) / (F.lit(k) + F.col("place"))).alias("s"))
        union = part if union is None else union.unionByName(part)
    return best(union.groupBy("qid", "id").agg(F.sum("s").alias("score")), most)


def limits(n: int, wide: bool = False) -> dict[str, int]:
    """How many candidates each stage keeps for a library of ``n`` files."""
    dense = next((k for most, k in V.DENSE_LIMITS if n <= most), min(V.DENSE_MOST, V.DENSE_BASE + n // V.DENSE_DIVISOR))
    table = V.LIMITS | (V.WIDE_LIMITS if wide else {})
    out = {name: min(most, max(least, base + n // divisor)) for name, (least, most, base, divisor) in table.items()}
    return out | {"dense": dense} | {name: min(most, max(least, dense * times // divisor)) for name, (least, most, times, divisor) in V.DENSE_PARTS.items()}


def rank_of(scored: DataFrame, wanted: DataFrame, bins: int = 4096) -> DataFrame:
    """(qid, id, rank): the true rank of wanted (qid, id) among all scored rows of a query, ties alike. Scores
    are counted in bins first, so that no query is ranked in one task."""
    ends = scored.groupBy("qid").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    placed = scored.join(ends, "qid").withColumn("bin", F.when(F.col("high") > F.col("low"), F.floor((F.col("high") - F.col("score")) / (F.col("high") - F.col("low")) * bins)).otherwise(0)).drop("low", "high")
    counts = placed.groupBy("qid", "bin").agg(F.count("*").alias("n"))
    before = counts.select("qid", "bin", (F.sum("n").over(W.partitionBy("qid").orderBy("bin")) - F.col("n")).alias("before"))
    within = placed.withColumn("k", F.rank().over(W.partitionBy("qid", "bin").orderBy(F.desc("score"))))
    return within.join(wanted.select("qid", "id").distinct(), ["qid", "id"], "left_semi").join(before, ["qid", "bin"]).select("qid", "id", (F.col("before") + F.col("k")).alias("rank"))


def coverage(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, id, name_share, query_share, is_title): how much of a name a query covers, how much of the
    query the name does, and whether the query is the name's title: two tokens or more, both shares
    85 % or more. Only files with a token in common come out."""
    found = hits(queries, files).where("field = 'name'").groupBy("qid", "id", "n_tokens").agg(F.count_distinct("token").alias("n"))
    names = files.select("id", F.size(F.array_distinct(T.stem_tokens(T.stem_of(F.col("name"))))).alias("name_size"))
    both = found.join(names, "id").select("qid", "id", "n_tokens", (F.col("n") / F.col("name_size")).alias("name_share"), (F.col("n") / F.col("n_tokens")).alias("query_share"))
    return both.select("qid", "id", "name_share", "query_share", ((F.col("n_tokens") >= 2) & (F.col("name_share") >= 0.85) & (F.col("query_share") >= 0.85)).alias("is_title"))


def pooled(sources: list[tuple[DataFrame, bool]], cap: int) -> DataFrame:
    """(qid, id, tier, pos): candidates of several sources (qid, id, ord), in the order of the sources and
    then of ``ord``, each once in its first place; cut at ``cap`` places, but those of pinned sources stay."""
    union = None
    for tier, (source, pinned) in enumerate(sources):
        part = source.select("qid", "id", F.lit(tier).alias("tier"), "ord", F.lit(pinned).alias("pinned"))
        union = part if union is None else union.unionByName(part)
    once = union.groupBy("qid", "id").agg(F.min(F.struct("tier", "ord")).alias("first"), F.max("pinned").alias("pinned"))
    placed = once.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("first", "id")))
    return placed.where((F.col("pos") <= cap) | F.col("pinned")).select("qid", "id", F.col("first.tier").alias("tier"), "pos")


def weak_queries(queries: DataFrame, scored: DataFrame, least: float) -> DataFrame:
    """(qid, n, top): queries without any scored file, or whose best score is below ``least``."""
    per = scored.groupBy("qid").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    all_queries = queries.select("qid").distinct().join(per, "qid", "left")
    return all_queries.select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit(0.0)).alias("top")).where(F.col("top") < least)
