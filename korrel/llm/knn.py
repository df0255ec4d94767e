"""The most similar vectors of every vector: a small-world graph per shard, results merged.

Shards are groups of neighbouring cells around centroids, one for about ``CELL_ROWS`` vectors, so that
cells stay as fine as the data however large the table. They are trained on a ``SHARE`` of the rows,
a region of the sample in each task; all rows are indexed. For routing, the mean of the sample is
taken off every vector: else a centroid near the mean would be among the nearest of vectors that have
nothing in common. A vector belongs to the shards of its nearest centroids: of ``PROBES`` those that
are less than ``MARGIN`` of cosine behind the best. One next to a centroid of its own joins one shard,
one between many cells joins many, so near vectors share a shard even at the border of cells.
Each shard builds a graph (see ``hnsw``) and answers for its own members; the answers of a vector's
shards are merged by cosine. Vectors travel to their shards in 20 bits a value: cosines differ by about
1e-6 at most, the last of the six decimals that are compared.

No task ever holds more than about ``2 * TASK_ROWS`` vectors, whatever the table. At most ``ALL_CENTROIDS``
serve the first level, as each worker holds them; beyond ``ALL_CENTROIDS * CELL_ROWS`` vectors cells grow
coarser. A shard with more members than ``TASK_ROWS`` is divided again: finer centroids are trained on a
bounded sample of its own members, in a task of each shard, and every member goes to the leaves of its
nearest ones. A leaf that is still too large is stored in parts by hash; parts and members meet in pairs
of bounded size, so nothing is lost.
Exact copies (two hashes of 64 bits agree) are indexed once and put back into the answers, so that a
group of copies of any size costs no more than one vector.

Defined results: null vectors, vectors with null, NaN or infinite values, all zeros, or another
length than most take no part; fewer rows than asked for give fewer neighbours; of equally similar
rows the smaller id comes first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korrel.llm.hnsw import Graph
from korrel.session import cut, lookup

#: Vectors that one task trains centroids on, about; share of the vectors that are trained on; centroids of
#: one task and in all, at most; vectors of one cell, about; sampled vectors of a centroid.
SAMPLE, SHARE, CENTROIDS, ALL_CENTROIDS, CELL_ROWS, PER_CENTROID = 30_000, 0.2, 4096, 131_072, 40, 8
#: Vectors of a shard, about, and at most in one task; vectors that one task of a divided shard routes.
SHARD_ROWS, TASK_ROWS, ROUTE_ROWS = 2500, 20_000, 50_000
#: Nearest centroids whose shards a vector joins, at most, and how far their cosines may be behind the best.
PROBES, MARGIN = 8, 0.15
#: Vectors and centroids that are compared at once. Share and number of vectors by which cells are weighed, at least.
ROWS, BLOCK, WEIGHED, WEIGHED_ROWS = 2048, 4096, 1 / 16, 50_000
#: Rounds of centroid training.
ROUNDS = 3


def unit_rows(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column, each of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dims)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centroids_of(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 0):
        nearest = np.concatenate([(sample[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(sample), 4096)])
        order = np.argsort(nearest, kind="stable")
        held, starts = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        centroids[held] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
    return centroids


def shards_of(centroids: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """A shard for each centroid: groups are halved along their main direction while too heavy."""

    def blocks(group: np.ndarray) -> Iterator[np.ndarray]:
        return (centroids[group[a : a + 16_384]].astype(np.float32) for a in range(0, len(group), 16_384))

    out = np.zeros(len(centroids), dtype=np.int32)
    waiting, shards = [np.arange(len(centroids))], 0
    while waiting:
        group = waiting.pop()
        if len(group) == 1 or weights[group].sum() <= most:
            out[group] = shards
            shards += 1
            continue
        own = list(blocks(group)) if len(group) <= 16_384 else None  # else as it is, in half precision
        parts = (lambda own=own, group=group: own or blocks(group))
        mean = sum(b.sum(axis=0) for b in parts()) / len(group)
        away = [((b - mean) ** 2).sum(axis=1) for b in parts()]
        axis = centroids[group[int(np.concatenate(away).argmax())]].astype(np.float32) - mean
        for _ in range(8):  # power iteration
            axis = sum((b - mean).T @ ((b - mean) @ axis) for b in parts())
            axis /= max(float(np.linalg.norm(axis)), 1e-30)
        order = group[np.argsort(np.concatenate([(b - mean) @ axis for b in parts()]), kind="stable")]
        total = np.cumsum(weights[order])
        at = min(max(int(np.searchsorted(total, total[-1] / 2)), 1), len(order) - 1)
        waiting += [order[:at], order[at:]]
    return out


def usable_vectors(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """(id, v) of the rows that take part, how many there may be, and the vectors' length."""
    v = F.col(vector)
    sizes = rows.where(v.isNotNull()).groupBy(F.size(v).alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return rows.select("id", v.cast("array<float>").alias("v")).where("false"), 0, 0
    good = (F.size(v) == sizes[0]["dims"]) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(good).select("id", v.cast("array<float>").alias("v")), sizes[0]["count"], sizes[0]["dims"]


def _copies(usable: DataFrame) -> DataFrame | None:
    """(id, first, class size) of every row that has exact copies; None if no row has any."""
    keys = usable.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    classes = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    classes = cut(classes)
    if classes.isEmpty():
        return None
    return cut(keys.join(classes, ["h1", "h2"]).select("id", "first", "n"))


def from_mean(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Directions from ``mean``."""
    y = x - mean
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)


def nearest_centroids(y: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the PROBES nearest centroids of each row, -1 for those too far behind the best; 1 - cosine)."""
    probes = min(PROBES, len(centroids))
    near, sims = np.empty((len(y), probes), dtype=np.int64), np.empty((len(y), probes), dtype=np.float32)
    for a in range(0, len(y), ROWS):
        part = y[a : a + ROWS]
        for b in range(0, len(centroids), max(BLOCK, probes)):
            s = part @ centroids[b : b + max(BLOCK, probes)].astype(np.float32).T
            if not b:
                n = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
                v = np.take_along_axis(s, n, 1)
                continue
            rows, cols = np.nonzero(s > v.min(axis=1, keepdims=True))  # few are better than the best so far
            if not len(rows):
                continue
            counts = np.bincount(rows, minlength=len(part))
            place = probes + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            all_n, all_v = (np.pad(z, ((0, 0), (0, int(counts.max()))), constant_values=c) for z, c in ((n, -1), (v, -np.inf)))
            all_n[rows, place], all_v[rows, place] = cols + b, s[rows, cols]
            best = np.argpartition(-all_v, probes - 1, axis=1)[:, :probes]
            n, v = np.take_along_axis(all_n, best, 1), np.take_along_axis(all_v, best, 1)
        near[a : a + ROWS], sims[a : a + ROWS] = np.where(v >= v.max(axis=1, keepdims=True) - MARGIN, n, -1), v
    return near, 1 - sims


def drawn(rows: DataFrame, seed: int, share: float | F.Column) -> DataFrame:
    """About ``share`` of the rows, by the hashes of their ids among all of 64 bits."""
    return rows.where(F.xxhash64(F.lit(seed), "id") / F.lit(2.0**64) + 0.5 < share)


def _centroids(usable: DataFrame, rows: int, dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, centroids), trained on a SHARE of the rows; None if no row takes part."""
    first = drawn(usable, 11, min(1.0, SAMPLE / max(rows, 1), max(SHARE, 2400 / max(rows, 1)))).select("v").toArrow()
    if not first.num_rows:
        if usable.isEmpty():
            return None
        first = usable.select("v").limit(SAMPLE).toArrow()  # few of the rows are usable
    x = unit_rows(first["v"], dims)
    mean = x.mean(axis=0) if len(x) > 1 else np.zeros(dims, dtype=np.float32)
    y = from_mean(x, mean)
    wide = min(rows * SHARE, ALL_CENTROIDS * PER_CENTROID)
    if wide <= SAMPLE:
        return mean, centroids_of(y, int(min(CENTROIDS, max(1, rows // CELL_ROWS), max(1, len(y) // PER_CENTROID)))).astype(np.float16)
    # regions of the sample, and parts of those that would be too large for a task
    few = min(len(y), math.ceil(wide / SAMPLE))
    regions = centroids_of(y, few)
    parts = np.ceil(np.bincount((y @ regions.T).argmax(1), minlength=few) * (wide / len(y) / SAMPLE / 1.5)).astype(np.int64).clip(1)
    sent = usable.sparkSession.sparkContext.broadcast((mean, regions, parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, regions, parts = sent.value
        for b in batches:
            if b.num_rows:
                x = unit_rows(b.column("v"), dims)
                region = (from_mean(x, mean) @ regions.T).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), pa.array(b.column("h").to_numpy() % parts[region], pa.int64()), packed(x)], names=["region", "part", "v"])

    def learn(group: pa.Table) -> pa.Table:
        y = from_mean(unpacked(group["v"], dims), sent.value[0])
        return pa.table({"centroids": pa.array([centroids_of(y, int(min(CENTROIDS, max(1, len(y) // PER_CENTROID)))).astype(np.float16).tobytes()], pa.binary())})

    hashed = drawn(usable, 23, wide / rows).select(F.expr("pmod(xxhash64(29, id), 1048576)").alias("h"), "v")
    learnt = hashed.mapInArrow(place, "region bigint, part bigint, v binary").groupBy("region", "part").applyInArrow(learn, "centroids binary").toArrow()
    held = [np.frombuffer(c.as_buffer(), dtype=np.float16).reshape(-1, dims) for c in learnt["centroids"]]
    if not held:
        return mean, regions.astype(np.float16)
    held.sort(key=lambda c: c[0].tobytes())  # the same shards however the rows came
    return mean, np.concatenate(held)


def _routing(usable: DataFrame, indexed: DataFrame, rows: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(mean, centroids, shard of each, estimated members of each shard); None if no row takes part."""
    found = _centroids(usable, rows, dims)
    if found is None:
        return None
    sent = usable.sparkSession.sparkContext.broadcast(found)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, centroids = sent.value
        n = np.zeros(len(centroids), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                near = nearest_centroids(from_mean(unit_rows(b.column("v"), dims), mean), centroids)[0]
                n += np.bincount(near[near >= 0], minlength=len(n))
        held = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(n[held])], names=["centroid", "n"])

    # a sixteenth is enough to tell the shards that hold more than 2 * TASK_ROWS
    share = min(1.0, max(WEIGHED, WEIGHED_ROWS / max(rows, 1)))
    counts = drawn(indexed, 31, share).mapInArrow(weigh, "centroid bigint, n bigint").groupBy("centroid").agg(F.sum("n").alias("n")).toArrow()
    weights = np.zeros(len(found[1]))
    weights[counts["centroid"].to_numpy()] = counts["n"].to_numpy() / share
    shard = shards_of(found[1], weights, SHARD_ROWS)
    return *found, shard, np.bincount(shard, weights=weights)


def _distinct_shards(y: np.ndarray, centroids: np.ndarray, shard_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of each different shard that a row's nearest centroids belong to."""
    near = nearest_centroids(y, centroids)[0]
    shards = np.sort(np.where(near >= 0, shard_of[near], -1), axis=1)
    first = shards >= 0
    first[:, 1:] &= shards[:, 1:] != shards[:, :-1]
    who, where = np.nonzero(first)
    return who, shards[who, where]


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column: the largest absolute value, and of each value 20 bits of its share in that."""
    dims = x.shape[1]
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30).astype(np.float32)
    q = (np.rint(x / scale * np.float32(2**19 - 1)).astype(np.int32) + 2**19).astype(np.uint32)
    low = np.zeros((len(x), dims + dims % 2), dtype=np.uint8)
    low[:, :dims] = q & 15
    parts = scale.view(np.uint8), (q >> 4).astype(np.uint16).view(np.uint8), low[:, ::2] | low[:, 1::2] << 4
    flat = np.ascontiguousarray(np.concatenate([p.reshape(len(x), -1) for p in parts], axis=1))
    return pa.Array.from_buffers(pa.binary(flat.shape[1]), len(x), [None, pa.py_buffer(flat)]).cast(pa.binary())


def unpacked(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    low = np.empty((len(flat), dims + dims % 2), dtype=np.uint8)
    low[:, ::2], low[:, 1::2] = flat[:, 4 + 2 * dims :] & 15, flat[:, 4 + 2 * dims :] >> 4
    q = (np.ascontiguousarray(flat[:, 4 : 4 + 2 * dims]).view(np.uint16).astype(np.int32) << 4 | low[:, :dims]) - 2**19
    return q.astype(np.float32) * (np.ascontiguousarray(flat[:, :4]).view(np.float32) / np.float32(2**19 - 1))


def members(usable: DataFrame, indexed: DataFrame, rows: int, dims: int) -> DataFrame | None:
    """(shard, part, other, id, stored, asks, v): the vectors that each task (shard, part, other)
    stores and those that it answers for; None if no row takes part."""
    spark = usable.sparkSession
    routing = _routing(usable, indexed, rows, dims)
    if routing is None:
        return None
    sent = spark.sparkContext.broadcast(routing[:3])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, centroids, shard_of = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(b.column("v"), dims)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            who, shards = _distinct_shards(from_mean(x, mean), centroids, shard_of)
            for a in range(0, len(who), 20_000):
                w = who[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(shards[a : a + 20_000], pa.int64()), pa.array(ids[w], pa.int64()), packed(x[w])], names=["shard", "id", "v"])

    routed = indexed.mapInArrow(route, "shard bigint, id bigint, v binary")
    whole = (F.lit(0).alias("part"), F.lit(0).alias("other"), "id", F.lit(True).alias("stored"), F.lit(True).alias("asks"), "v")
    # at most as many as there are centroids; a heavy shard has one centroid, which counts each member once
    large = {s: math.ceil(n) for s, n in enumerate(routing[3].tolist()) if n > TASK_ROWS}
    if not large:
        return routed.select("shard", *whole)
    small = routed.where(~F.col("shard").isin(list(large))).select("shard", *whole)
    leaves = _leaves(routed.where(F.col("shard").isin(list(large))), indexed, large, dims, sent)
    sizes = leaves.groupBy("shard").agg(F.count("*").alias("n"))
    over = cut(sizes.where(F.col("n") > TASK_ROWS))
    if over.isEmpty():
        return small.unionByName(leaves.select("shard", *whole))
    # parts by hash are not equally large
    parts = F.ceil(F.coalesce("n", F.lit(1)) / (TASK_ROWS - min(4 * TASK_ROWS**0.5, TASK_ROWS / 2))).cast("int")
    known = lookup(leaves, sizes.withColumn("members", F.col("n")), ["shard"], "members").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts")).cast("int"))
    # a stored row meets the askers of every part, an asker the stored rows of every part
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("p")))).alias("x")
    stored = known.select("shard", F.col("own").alias("part"), pairs, "id", "v", "own").select("shard", "part", F.col("x.p").alias("other"), "id", F.lit(True).alias("stored"), (F.col("x.p") == F.col("own")).alias("asks"), "v")
    asking = known.select("shard", F.col("own").alias("other"), pairs, "id", "v", "own").where("x.p <> own").select("shard", F.col("x.p").alias("part"), "other", "id", F.lit(False).alias("stored"), F.lit(True).alias("asks"), "v")
    return small.unionByName(stored).unionByName(asking)


def _leaves(wide: DataFrame, indexed: DataFrame, large: dict[int, int], dims: int, sent) -> DataFrame:
    """(shard, id, v): the members of the too large shards (shard, id, v) in leaves of their own. ``large``
    has the number of members of each such shard; it has at most CENTROIDS entries."""
    sizes = F.create_map(*[F.lit(x) for s, n in sorted(large.items()) for x in (int(s), int(n))])
    n = sizes[F.col("shard")]
    finer = F.least(F.lit(CENTROIDS), F.greatest(F.lit(2), F.ceil(n / CELL_ROWS)))

    def learn(group: pa.Table) -> pa.Table:
        mean = sent.value[0]
        y = from_mean(unpacked(group["v"], dims), mean)
        shard, rows = group["shard"][0].as_py(), large[group["shard"][0].as_py()]
        k = int(min(CENTROIDS, max(2, rows // CELL_ROWS), max(1, len(y) // PER_CENTROID)))
        centroids = centroids_of(y, k)
        near = nearest_centroids(y, centroids)[0]
        leaf = shards_of(centroids, np.bincount(near[near >= 0], minlength=k) * (rows / len(y)), SHARD_ROWS)
        return pa.table({"shard": pa.array([shard], pa.int64()), "leaf": pa.array([leaf.tolist()], pa.list_(pa.int32())), "centroids": pa.array([centroids.tobytes()], pa.binary())})

    sample = drawn(wide, 13, finer * PER_CENTROID / n)
    fine = cut(sample.groupBy("shard").applyInArrow(learn, "shard bigint, leaf array<int>, centroids binary"))
    # as many tasks of each shard as its members need, each with the shard's centroids
    salts = F.ceil(n / ROUTE_ROWS).cast("int")
    salted = wide.withColumn("salt", F.pmod(F.xxhash64(F.lit(17), "id"), salts).cast("int"))
    tables = fine.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def place(rows: pa.Table, table: pa.Table) -> pa.Table:
        if not rows.num_rows or not table.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64()), "away": pa.array([], pa.float32())})
        centroids = np.frombuffer(table["centroids"][0].as_py(), dtype=np.float32).reshape(-1, dims)
        leaf_of = np.array(table["leaf"][0].as_py(), dtype=np.int64) + table["shard"][0].as_py() * 2 * CENTROIDS + CENTROIDS * CENTROIDS
        y = from_mean(unpacked(rows["v"], dims), sent.value[0])
        near, away = nearest_centroids(y, centroids)
        who, where = np.nonzero(near >= 0)
        return pa.table({"id": pa.array(rows["id"].to_numpy()[who], pa.int64()), "leaf": pa.array(leaf_of[near[who, where]], pa.int64()), "away": pa.array(away[who, where])})

    placed = salted.groupBy("shard", "salt").cogroup(tables.groupBy("shard", "salt")).applyInArrow(place, "id bigint, leaf bigint, away float")
    # of the leaves of all its shards a vector joins those of its nearest centroids
    best = placed.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("away", "leaf"))), 1, PROBES).alias("best"))
    near = F.filter("best", lambda s: s["away"] <= F.col("best")[0]["away"] + MARGIN)
    chosen = best.select("id", F.explode(F.array_distinct(F.transform(near, lambda s: s["leaf"]))).alias("shard"))
    unit = wide.groupBy("id").agg(F.any_value("v").alias("v"))
    return cut(chosen.join(unit, "id").select("shard", "id", "v"))


def nearest_of_all(rows: DataFrame, most: int = 10, vector: str = "embedding") -> DataFrame:
    """(id, near): for every usable row its ``most`` nearest other rows, an array of
    (away = 1 - cosine, neighbour), nearest first."""
    usable, count, dims = usable_vectors(rows, vector)
    near_type = "array<struct<away:float,neighbour:bigint>>"
    none = usable.select("id", F.expr(f"CAST(array() AS {near_type})").alias("near")).where("false")
    if not count:
        return none
    copies = _copies(usable)
    indexed = usable if copies is None else usable.join(copies.where("id <> first").select("id"), "id", "left_anti")
    routed = members(usable, indexed, count, dims)
    if routed is None:
        return none

    def answer(group: pa.Table) -> pa.Table:
        ids, x = group["id"].to_numpy(), unpacked(group["v"], dims)
        stored, asks = (group[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("stored", "asks"))
        order = np.argsort(ids, kind="stable")  # the same graph however the rows came
        ids, x, stored, asks = ids[order], x[order], stored[order], asks[order]
        graph = Graph(x[stored])
        own = ids[stored]
        outs = []
        if asks[stored].any():  # all or none of the stored ones ask
            outs.append((own, *graph.neighbours(most)))
        if not stored.all():
            outs.append((ids[~stored], *graph.nearest(x[~stored], most)))
        lists, whose = [], []
        for who, nodes, sims in outs:
            if not len(own):
                continue
            good = nodes >= 0
            counts = good.sum(axis=1)
            items = pa.StructArray.from_arrays([pa.array((1 - sims[good]).astype(np.float32)), pa.array(own[nodes[good]], pa.int64())], names=["away", "neighbour"])
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items))
            whose.append(pa.array(who, pa.int64()))
        if not lists:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("away", pa.float32()), ("neighbour", pa.int64())])))})
        return pa.table({"id": pa.chunked_array(whose), "near": pa.chunked_array(lists)})

    answers = routed.groupBy("shard", "part", "other").applyInArrow(answer, f"id bigint, near {near_type}")
    merged = answers.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("all"))  # at most PROBES lists (times parts)
    rounded = F.transform("all", lambda s: F.struct(F.round(s["away"], 6).alias("away"), s["neighbour"].alias("neighbour")))
    found = merged.select("id", F.slice(F.array_sort(F.array_distinct(rounded)), 1, most).alias("near"))
    return found if copies is None else _with_copies(found, copies, most)


def _with_copies(found: DataFrame, copies: DataFrame, most: int) -> DataFrame:
    """Answers for all rows from answers for the first of each class of copies. Of a class, the
    ``most`` + 1 smallest ids are enough for any answer."""
    order = W.partitionBy("first").orderBy("id")
    leading = copies.select("first", "id", F.row_number().over(order).alias("k")).where(F.col("k") <= most + 1)
    members = leading.groupBy("first").agg(F.array_sort(F.collect_list("id")).alias("members"))
    one = F.explode("near").alias("x")
    spread = found.select("id", one).select("id", "x.away", F.col("x.neighbour").alias("first")).join(members, "first", "left")
    spread = spread.select("id", F.explode(F.coalesce("members", F.array("first"))).alias("neighbour"), "away")
    others = spread.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("away", "neighbour"))), 1, most).alias("near"))
    whole = members.join(others.withColumnRenamed("id", "first"), "first", "left")
    same = F.transform("members", lambda m: F.struct(F.lit(0.0).cast("float").alias("away"), m.alias("neighbour")))
    around = whole.select("first", F.concat(same, F.coalesce("near", F.expr("CAST(array() AS array<struct<away:float,neighbour:bigint>>)"))).alias("pool"))
    mine = copies.join(around, "first").select("id", F.expr(f"slice(filter(pool, s -> s.neighbour <> id), 1, {most})").alias("near"))
    single = others.join(copies.select("id"), "id", "left_anti")
    return single.unionByName(mine)


def similar_pairs(rows: DataFrame, most: int = 10, vector: str = "embedding") -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which at least one is among the ``most`` nearest of the other."""
    pairs = nearest_of_all(rows, most, vector).select("id", F.explode("near.neighbour").alias("other"))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
