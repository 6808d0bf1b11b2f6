"""Mixing sources to target weights (operator 6): Sainte-Lague apportionment of equal-token blocks.

1. A source's size is the words of its texts. Its target is its share, by weight, of all words; no target passes `max_epochs`
   times its source's size, and the excess is shared again by weight.
2. The mix is so many blocks of `block_words`. They go to sources by the highest quotients votes / (2 k + 1), votes being the
   targets; a source's blocks then go to its shards the same way, votes being the shards' words. Shards are by a hash of the row,
   as many for all sources as leave about `shard_docs` rows in a shard of the largest, so a hot source is dealt over many tasks.
3. A shard's texts, in seeded order, are one run of words cut into blocks. All of it is taken as often as the quota says; the
   blocks left are the seeded selection: every (blocks / quota)-th block from a seeded one on, so a document gives the words that it
   has in chosen blocks.

Targets and sources' blocks come from aggregates over one row a source; no task holds all sources, and texts aren't shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellscape.llm.common import staged
from cellscape.operators.ranking import row_numbers
from cellscape.shipping import ship

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_DOCS = 5_000
MAX_EPOCHS = 3
SEED = 20_240_607


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats of each entry by highest quotients votes / (2 k + 1), at most `most` each; ties to the earlier entry.

    The last quotient that still wins is found by bisection on the divisor d, where entry i has floor(votes / d + 1/2) seats;
    what is then left, ties and rounding, goes one by one.
    """
    votes, most = np.asarray(votes, dtype=np.float64), np.asarray(most, dtype=np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), most).astype(np.int64)
    low, high = votes[votes > 0].min() / (2 * most.max() + 2), 4 * votes.max() + 1  # low gives all, high none
    for _ in range(200):
        mid = math.sqrt(low * high)
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
        if high / low < 1 + 1e-15:
            break
    out = given(high)
    while (left := seats - out.sum()) > 0:
        quotient = np.where((out < most) & (votes > 0), votes / (2 * out + 1), -1.0)
        out[np.argsort(-quotient, kind="stable")[: min(left, int((quotient > 0).sum()))]] += 1
    return out


def source_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target to rows (source_size, weight): shares of the sum of sizes by weight, none above max_epochs times its size; the
    excess is shared again by weight until none is above. A pass over the sources each time some of them reach their bound."""
    most, level = F.col("source_size") * F.lit(float(max_epochs)), math.inf
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:  # sources whose share at the last level passed their bound have it; the others share the rest
        full = F.col("weight") * F.lit(level) > most if math.isfinite(level) else F.lit(False)
        given, weight = sources.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        now = (total - given) / weight if weight > 0 else math.inf
        if not math.isfinite(now) or abs(now - level) <= 1e-13 * now:
            return sources.withColumn("target", F.when(full, most).otherwise(F.col("weight") * F.lit(now if math.isfinite(now) else 0.0)))
        level = now


def source_blocks(sources: DataFrame, block_words: int, max_epochs: int) -> DataFrame:
    """Adds blocks to rows (place, source_size, target): Sainte-Lague seats for votes `target`, at most those of max_epochs passes.

    The divisor at which seats floor(votes / d + 1/2) just fit is closed in on by aggregates over 64 divisors at once; what is then
    left, ties and rounding, goes by quotient and then by place.
    """
    most = F.ceil(F.col("source_size") * max_epochs / block_words)
    n_blocks, low, high, room = sources.agg(F.round(F.sum("target") / block_words).cast("long"), F.min(F.when(F.col("target") > 0, F.col("target"))), F.max("target"), F.sum(F.when(F.col("target") > 0, most))).first()
    if not low:
        return sources.withColumn("blocks", F.lit(0).cast("long"))
    seats, at_most = min(n_blocks, room), sources.agg(F.max(most)).first()[0]
    given = lambda d: F.least(F.floor(F.col("target") / F.lit(d) + 0.5), most)
    low, high, held = low / (2 * at_most + 2), 4 * high + 1, -1
    while high / low > 1 + 1e-13 and held != seats:
        steps = [low * (high / low) ** (k / 64) for k in range(1, 65)]
        sums = sources.agg(*[F.sum(given(d)) for d in steps]).first()
        k = next(i for i, n in enumerate(sums) if n <= seats or i == 63)
        low, high, held = steps[k - 1] if k else low, steps[k], sums[k]
        if k and steps[k - 1] >= steps[k]:
            break
    out = sources.withColumn("blocks", given(high).cast("long"))
    left = seats - (out.agg(F.sum("blocks")).first()[0] or 0)
    if left <= 0:
        return out
    quotient = F.col("target") / (2 * F.col("blocks") + 1)
    more = out.where((F.col("blocks") < most) & (F.col("target") > 0)).orderBy(F.desc(quotient), "place").limit(int(left)).select("place", F.lit(1).alias("more"))
    return out.join(more, "place", "left").withColumn("blocks", F.col("blocks") + F.coalesce("more", F.lit(0))).drop("more")


def shard_blocks(shards: pd.DataFrame, block_words: int, max_epochs: int) -> pd.DataFrame:
    """Adds quota, in blocks, to the shards of one source; one row for about shard_docs documents."""
    shards = shards.sort_values("shard", kind="stable").reset_index(drop=True)
    size = shards["shard_size"].to_numpy(np.int64)
    quota = sainte_lague(size, int(shards["blocks"].iloc[0]) if len(shards) else 0, max_epochs * -(-size // block_words))
    return shards.assign(quota=quota)


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, max_epochs: int = MAX_EPOCHS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (doc_id, text, source; others are left aside).

    weights repeat over the sources in code point order, null (a source of its own) last. A null or empty text has size 0 and
    gives 0; a source without words has target 0; repeated rows are rows like any other, one after the other in their shard; an
    empty table gives none. Order in a shard is by a seeded hash of the row: reruns agree whatever the partitioning.
    """
    ship(docs.sparkSession)
    mark = F.xxhash64(F.col("doc_id").cast("long"), "source", "text")
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mark.alias("mark")), "mix-sizes")
    keyed = sized.withColumn("source_key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")))
    counted = staged(keyed.groupBy("source_key").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "mix-sources")
    shards = max(1, math.ceil((counted.agg(F.max("n")).first()[0] or 0) / shard_docs))
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("mark", F.lit(seed), F.lit("shard")), F.lit(shards)).cast("int"))
    entries = keyed.groupBy("source_key", "shard", "doc_id", "source", "size", "mark").agg(F.count("*").alias("copies"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = staged(row_numbers(counted, ["source_key"], "place").withColumn("weight", weight), "mix-places")
    targets = staged(source_targets(placed, max_epochs), "mix-targets")
    by_source = source_blocks(targets, block_words, max_epochs).select("source_key", "source_size", "target", "blocks")
    by_shard = keyed.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = by_shard.join(by_source, "source_key").groupBy("source_key").applyInPandas(
        lambda pdf: shard_blocks(pdf, block_words, max_epochs), "source_key string, shard int, shard_size long, source_size long, target double, blocks long, quota long"
    )
    # a shard's n blocks (the last may be short): `whole` passes over all and `rest` chosen ones, the i-th if (i rest + phase) div n steps up after it
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * max_epochs)
    quotas = quotas.withColumns({"n": F.ceil(F.col("shard_size") / block_words).cast("long"), "words": words}).withColumn("whole", F.expr("CASE WHEN n > 0 THEN words div shard_size ELSE 0 END"))
    quotas = quotas.withColumn("rest", F.round((F.col("words") - F.col("whole") * F.col("shard_size")) / block_words).cast("long")).drop("words")
    quotas = quotas.withColumn("phase", F.when(F.col("n") > 0, F.pmod(F.xxhash64("source_key", "shard", F.lit(seed), F.lit("phase")), F.col("n")))).drop("quota", "blocks", "shard_size")
    before = W.partitionBy("source_key", "shard").orderBy("order", "doc_id", "mark").rowsBetween(W.unboundedPreceding, -1)
    every = entries.join(quotas, ["source_key", "shard"]).withColumn("order", F.xxhash64("mark", F.lit(seed), F.lit("order")))
    every = every.withColumn("begin", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
    every = every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("begin", F.expr("begin + (copy - 1) * size")).withColumn("end", F.expr("begin + size"))
    for side in ("begin", "end"):  # chosen words before it
        block = f"({side} div {block_words})"
        steps = f"(({block} + {{0}}) * rest + phase) div n"
        every = every.withColumn(f"to_{side}", F.expr(f"{steps.format(0)} * {block_words} + ({steps.format(1)} - {steps.format(0)}) * ({side} % {block_words})"))
    taken = F.when(F.col("n") > 0, F.expr("whole * size + to_end - to_begin")).otherwise(0).cast("long")
    return every.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
