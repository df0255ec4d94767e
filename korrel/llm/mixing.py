"""Mixing sources to target weights.

Each source has a target share of all tokens and a cap on how often one document may be used. The
mix is the largest one that the scarcest source allows. A source's documents come in a fixed random
order, in passes; a pass is repeated as often as the cap allows.

The tokens of a source are cut into blocks of equal size, and the blocks of all sources are
interleaved by Pfair scheduling: with weight w, block i of a source is released at slot floor(i/w)
and due at slot ceil((i+1)/w), and every slot takes the released block that is due first. So after
any number of slots each source is less than one block away from its share. Weights are exact
fractions of the target shares. How many blocks of each source come before every FRAME-th slot is
found in one pass over the frames, a few numbers of each; the frames between are scheduled where
their documents are, on the executors.

Defined results: documents with null, unknown or untargeted source, or without tokens, take no part;
a source without documents gets nothing, and the other shares grow in proportion; a null cap is 1;
no targets or no documents give an empty mix. A document belongs to the block in which it starts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korrel.llm.tokens import VOCABULARY, with_token_counts
from korrel.session import cut

#: Slots that are scheduled together, and slots after a boundary for which room is looked for.
FRAME, LOOK = 16_384, 2000
#: Tokens of a block.
BLOCK_TOKENS = 2048
#: Documents of a source in one bucket of the running totals, about.
BUCKET_DOCS = 20_000


def weights_of(shares: dict[str, float]) -> dict[str, Fraction]:
    """The exact weight of each source with a positive share; they sum to 1."""
    exact = {s: Fraction(x) for s, x in sorted(shares.items()) if x > 0}
    total = sum(exact.values())
    return {s: x / total for s, x in exact.items()}


def release(i: int, w: Fraction) -> int:
    """The slot from which block ``i`` may be taken."""
    return i * w.denominator // w.numerator


def deadline(i: int, w: Fraction) -> int:
    """The slot before which block ``i`` must have been taken."""
    return -(-(i + 1) * w.denominator // w.numerator)


def boundaries(weights: dict[str, Fraction], blocks: dict[str, int], frame: int = FRAME) -> dict[str, list[int]]:
    """For each source how many of its blocks come before slots 0, frame, 2 * frame and so on, until all
    have had at least ``blocks``. Each number is the share of the slots rounded down or up."""
    out = {s: [0] for s in weights}
    at = 0
    while any(out[s][-1] < blocks.get(s, 0) for s in weights):
        at += frame
        down = {s: at * w.numerator // w.denominator for s, w in weights.items()}
        early = {s for s in weights if out[s][-1] > down[s]}  # has had its block before the last boundary
        up = early | _taken(weights, down, early, at)
        for s in weights:
            out[s].append(down[s] + (s in up))
    return out


def _taken(weights: dict[str, Fraction], down: dict[str, int], early: set[str], at: int) -> set[str]:
    """The sources whose block that is open at slot ``at`` comes before it. What is left must fit
    the slots after: so of the blocks due by any slot as many must come before as would not fit. Of
    those that may, the ones released first come before."""
    ends = {s: deadline(down[s], w) for s, w in weights.items() if s not in early and at * w.numerator % w.denominator}
    by_release = sorted(ends, key=lambda s: (release(down[s], weights[s]), ends[s], s))
    wanted = at - sum(down.values()) - len(early)
    taken: set[str] = set()
    for b in range(at + 1, min(max(ends.values(), default=at), at + LOOK) + 1):
        prefix = [s for s in by_release if ends[s] <= b]
        inner = sum(max(0, b * w.numerator // w.denominator + (-at * w.numerator // w.denominator)) for w in weights.values())
        over = len([s for s in prefix if s not in taken]) + inner - (b - at)
        taken |= {s for s in [s for s in prefix if s not in taken][: max(over, 0)]}
    return taken | set([s for s in by_release if s not in taken][: max(wanted - len(taken), 0)])


def frame_schedule(weights: dict[str, Fraction], first: dict[str, int], after: dict[str, int], start: int) -> dict[str, list[int]]:
    """The slots of the blocks ``first`` to ``after`` (exclusive) of each source in the frame that begins
    at slot ``start``, by earliest deadline first."""
    size = sum(after[s] - first[s] for s in weights)
    waiting: list[tuple[int, str]] = [(max(start, release(first[s], w)), s) for s, w in weights.items() if first[s] < after[s]]
    heapq.heapify(waiting)
    due: list[tuple[int, str]] = []
    out: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(start, start + size):
        while waiting and (waiting[0][0] <= slot or not due):
            _, s = heapq.heappop(waiting)
            heapq.heappush(due, (deadline(first[s] + len(out[s]), weights[s]), s))
        _, s = heapq.heappop(due)
        out[s].append(slot)
        if (following := first[s] + len(out[s])) < after[s]:
            heapq.heappush(waiting, (release(following, weights[s]), s))
    return out


def _plan(documents: DataFrame, targets: DataFrame, path: str) -> tuple[DataFrame, list[dict]]:
    """The counted documents, and for each targeted source what it has and what it shall give."""
    aims = [r.asDict() for r in targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()]
    counted = with_token_counts(documents.select("doc_id", "source", "text"), path=path).drop("text")
    counted = cut(counted.where(F.col("source").isin([a["source"] for a in aims])).where("n_tokens > 0"))
    have = {r.source: (r.n, r.tokens, r.longest) for r in counted.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")).collect()}
    for a in aims:
        a["share"], a["repeats"] = max(a["share"] or 0.0, 0.0), max(a["repeats"] or 1, 1)
        a["docs"], a["tokens"], a["longest"] = have.get(a["source"], (0, 0, 0))
    active = sum(a["share"] for a in aims if a["tokens"])
    sizes = [a["tokens"] * a["repeats"] * active / a["share"] for a in aims if a["tokens"] and a["share"]]
    total = min(sizes, default=0)
    for a in aims:
        a["need"] = int(total * a["share"] / active + 1e-6) if a["tokens"] and active else 0
    return counted, aims


def mix(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """(slot, source, block_no, place, doc_id, use_no, n_tokens): one row per use of a document, in
    the order (slot, place). ``place`` is the token of the block at which the document starts,
    ``use_no`` counts a document's uses from 1."""
    return _mixed(documents, targets, path, block_tokens, seed)[0]


def _mixed(documents: DataFrame, targets: DataFrame, path: str, block_tokens: int, seed: int) -> tuple[DataFrame, list[dict]]:
    spark = documents.sparkSession
    counted, aims = _plan(documents, targets, path)
    used = [a for a in aims if a["need"]]
    weights = weights_of({a["source"]: a["share"] for a in used})
    # the last document may reach beyond what its source shall give
    edges = boundaries(weights, {a["source"]: (a["need"] + a["longest"]) // block_tokens + 1 for a in used})
    # bounded: one row per targeted source
    aim = spark.createDataFrame([(a["source"], a["need"], a["tokens"], max(1, a["docs"] // BUCKET_DOCS)) for a in used], "source string, need bigint, have bigint, buckets bigint")
    # Running totals over a fixed random order: within buckets of bounded size, then over buckets.
    placed = counted.join(F.broadcast(aim), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    placed = placed.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = sums.select("source", "bucket", (F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    order = W.partitionBy("source", "bucket").orderBy("h", "doc_id")
    placed = placed.join(before, ["source", "bucket"]).withColumn("at", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens"))
    # a use counts if its middle lies within what the source shall give
    uses = F.floor((F.col("need") - F.col("at") - F.col("n_tokens") / 2) / F.col("have")) + 1
    placed = placed.withColumn("uses", uses.cast("int")).where("uses > 0")
    each = placed.withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    each = each.withColumn("start", (F.col("use_no") - 1) * F.col("have") + F.col("at")).withColumn("block_no", F.floor(F.col("start") / block_tokens))
    place = (F.col("start") % block_tokens).cast("int")
    each = each.select("source", "block_no", place.alias("place"), "doc_id", "use_no", "n_tokens")
    sent = spark.sparkContext.broadcast((weights, {s: np.array(e) for s, e in edges.items()}))

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, edges = sent.value

        @lru_cache(32)
        def frame(f: int) -> dict[str, np.ndarray]:
            return {s: np.array(x) for s, x in frame_schedule(weights, *({s: int(e[f + k]) for s, e in edges.items()} for k in (0, 1)), f * FRAME).items()}

        for b in batches:
            slot = np.zeros(len(b), dtype=np.int64)
            block, source = b["block_no"].to_numpy(), b["source"].to_numpy()
            for s in set(source):
                own = np.nonzero(source == s)[0]
                frames = np.searchsorted(edges[s], block[own], side="right") - 1
                for f in np.unique(frames):
                    at = own[frames == f]
                    slot[at] = frame(int(f))[s][block[at] - edges[s][f]]
            b.insert(0, "slot", slot)
            yield b

    return each.mapInPandas(slots, "slot bigint, source string, block_no bigint, place int, doc_id bigint, use_no int, n_tokens bigint"), aims


def mix_report(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """One row per targeted source: documents and tokens there, its target share, what the mix took,
    the share really reached, and the most uses of one document."""
    spark = documents.sparkSession
    mixed, aims = _mixed(documents, targets, path, block_tokens, seed)
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    taken = per_doc.groupBy("source").agg(F.sum("uses").alias("uses"), F.count("*").alias("docs_used"), F.max("uses").alias("most_uses"), F.sum("tokens").alias("mix_tokens"))
    there = spark.createDataFrame([(a["source"], float(a["share"]), int(a["repeats"]), a["docs"], a["tokens"]) for a in aims], "source string, target_share double, max_repeats int, docs bigint, tokens bigint")
    filled = there.join(taken, "source", "left").fillna(0, ["uses", "docs_used", "most_uses", "mix_tokens"])
    total = F.sum("mix_tokens").over(W.partitionBy())  # one row per targeted source
    return filled.withColumn("reached_share", F.when(total > 0, F.col("mix_tokens") / total).otherwise(0.0))
