"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words. A document is taken whole
``floor(target / source size)`` times and once more with the fractional probability
that remains. The extra copies are drawn by the cube method: probabilities move along
the null space of two constraints (words, documents), so both totals stay exact until
at most two documents of a source are undecided; those land where the word total comes
closest to the target.

The flight is a tree: blocks of about ``block`` documents of one source fly
independently and leave at most two undecided documents each, which form the blocks
of the next round. No source is gathered in one task. Decided documents never move
again. Directions and order come from hashes, so reruns agree.

Defined results
* null or blank text: size 0, taken 0; a source without words has target 0;
* null source: a source of its own, last in order; repeated rows are documents;
* a target stops at ``max_repeats`` times its source's size, the excess is shared
  again by weight among the others; an empty table gives an empty table;
* extra columns are ignored by ``mix`` and kept by ``sample_stage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions.ranking import global_index
from retailflow.llm.common import small_side, staged

#: Weights dealt to the sources in order, repeating (fixed by the contract).
WEIGHTS = (5.0, 2.0, 1.0)
NEAR = 1e-9  # a probability this near 0 or 1 is decided


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: float = 3.0, share: float = 1.0) -> DataFrame:
    """source, source_size, docs, target: words by weight, filled up to the limits.

    The level at which targets stop rising is found by a few aggregations over the
    table of sources; only two numbers a round come to the driver.
    """
    spark = sizes.sparkSession
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = global_index(sources, F.col("source").asc_nulls_last(), name="place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights))
    ranked = staged(spark, ranked.withColumn("weight", weight).drop("place"), "mix-sources")
    limit = max_repeats * F.col("source_size")
    goal = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, goal = 0.0, share * goal
    while True:
        over = F.col("weight") * level > limit
        fixed, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        risen = (goal - fixed) / open_weight if open_weight else level
        if risen <= level:
            break
        level = risen
    target = F.least(F.col("weight") * F.lit(level), limit)
    return ranked.select("source", "source_size", "docs", target.alias("target"))


def fly(size: list, prob: list, seed: int) -> list:
    """One flight: probabilities after moving until at most two stay fractional.

    Three units at a time: (s2-s3, s3-s1, s1-s2) keeps the sums of probabilities and
    of words; equal sizes move as a pair.
    """
    import random

    rng = random.Random(seed)
    window: list = []
    for k in range(len(prob)):
        if NEAR < prob[k] < 1 - NEAR:
            window.append(k)
        while len(window) == 3 or (len(window) == 2 and size[window[0]] == size[window[1]]):
            a, b = window[0], window[1]
            step = [1.0, -1.0]
            units = [a, b]
            if len(window) == 3:
                c = window[2]
                step = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
                units = [a, b, c]
                if not any(step):
                    units, step = [a, b], [1.0, -1.0]
            up = min(((1 - prob[u]) / d if d > 0 else prob[u] / -d) for u, d in zip(units, step) if d)
            down = min((prob[u] / d if d > 0 else (1 - prob[u]) / -d) for u, d in zip(units, step) if d)
            move = up if rng.random() * (up + down) < down else -down
            for u, d in zip(units, step):
                prob[u] = min(1.0, max(0.0, prob[u] + move * d))
                if prob[u] < NEAR or prob[u] > 1 - NEAR:
                    prob[u] = float(round(prob[u]))
            window = [u for u in window if NEAR < prob[u] < 1 - NEAR]
    return prob


def land(size: list, prob: list) -> list:
    """Decide the last few units: the choice whose words come closest to expectation."""
    from itertools import product

    left = [k for k in range(len(prob)) if NEAR < prob[k] < 1 - NEAR]
    aim = sum(size[k] * prob[k] for k in left)
    best = min(product((0.0, 1.0), repeat=len(left)), key=lambda c: (abs(sum(size[k] * v for k, v in zip(left, c)) - aim), c))
    for k, v in zip(left, best):
        prob[k] = v
    return prob


def _flight(last_round: bool):
    def run(key, frame):
        import zlib

        frame = frame.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        size, prob = frame["size"].astype(float).tolist(), frame["prob"].tolist()
        prob = fly(size, prob, zlib.crc32(repr((key[0], int(key[1]))).encode()))
        frame["prob"] = land(size, prob) if last_round else prob
        return frame

    return run


def _undecided(column="prob"):
    return (F.col(column) > NEAR) & (F.col(column) < 1 - NEAR)


def mix(docs: DataFrame, block: int = 2048, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    spark = docs.sparkSession
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sizes = docs.select("doc_id", "source", n_words.cast("long").alias("size"))
    sizes = staged(spark, sizes, "mix-sizes")
    targets = staged(spark, source_targets(sizes, **options), "mix-targets")
    t = small_side(targets).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sizes.join(t, sizes["source"].eqNullSafe(t["_source"]))
        .withColumn("whole", F.floor(rate + NEAR))
        .withColumn("prob", F.greatest(rate - F.col("whole"), F.lit(0.0)))
        .withColumn("n_blocks", F.ceil(F.col("docs") / block))
        .withColumn("part", F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.col("n_blocks")))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "prob", "n_blocks", "part")
    )
    largest = (targets.agg(F.max("docs")).first()[0] or 0) / block
    done = []
    while True:
        last_round = largest <= 1
        flown = rows.groupBy("source", "part").applyInPandas(_flight(last_round), rows.schema)
        flown = staged(spark, flown, "mix-flight")
        if last_round:
            done.append(flown)
            break
        done.append(flown.where(~_undecided()))
        # at most two of a block are left: hundreds of blocks make one of the next round
        rows = flown.where(_undecided()).withColumn("part", F.floor(F.col("part") / (block // 2)))
        largest = largest / (block // 2)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("whole") + F.round("prob").cast("long"))).alias("taken"),
    )


def sample_stage(docs: DataFrame, **options) -> DataFrame:
    """Documents as the mix takes them: a document taken twice stands there twice."""
    taken = mix(docs, **options).where(F.col("taken") > 0)
    times = taken.groupBy("doc_id").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    times = times.withColumnRenamed("doc_id", "_mixed_id")
    # the document's own columns travel in a struct, whatever their names
    rows = docs.select("doc_id", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    joined = rows.join(times, rows["doc_id"].eqNullSafe(times["_mixed_id"]))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
