"""Operator 8, mixing sources to target weights by entropy balancing.

Each document has a rate, the number of copies the mix takes of it. Of all rates of at most `most` by which each source's
copies hold its target number of tokens, the mix takes those nearest to one copy each in relative entropy over
documents: min(most, exp(dual of the source * size)), sizes in units of the source's mean. The dual is convex; safeguarded
Newton iterations solve it for all sources at once, each step one distributed sum of sizes, and of squared sizes, times the rates.

The rates are then rounded into whole copies (0, 1 or 2 where `most` is 2). A source's documents come in tiers, from the
longest down, in a tier by size and then by a hash of id, text and source; a document gets the whole steps of the running sum of rates
that it makes, so in a tier the words taken miss the rates' sum by less than the tier's longest document. What a tier
misses is made up for by the next one, whose rates are scaled for it, so an odd long document is balanced by shorter ones.
All this is done over blocks, documents of one source, size and hash range, of which only counts are needed.

Sizes are numbers of words (runs of anything but space and 09 to 0D); null and empty texts have size 0 and are never
taken. A null source is a source of its own, the last in order. Rows with one id and text are ordered one after the other
by a hash of the row only, so that equal rows may swap their copies, which gives the same table. A table without rows gives none.
Extra columns are ignored; those to keep may have any names but the result's.

A source's documents are dealt out by size and hash range, so no task holds a source; counts are summed before they are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Documents of a tier have at least so many words.
TIERS = (2048, 256, 32, 1)
#: Hash ranges in which a source's documents of one size are put in order.
RANGES = 1024
#: Newton steps at most, and the relative error of a source's tokens at which they end.
STEPS, CLOSE = 40, 1e-7


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, a hash that orders the documents, and the columns to keep."""
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text", "source").alias("_order"), *keep)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target: one row a source. sizes: source, size and n, rows of that size. A capped target's excess goes to the others by weight, so those
    are all at one level; sources in order of the level at which they are full give it."""
    by = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    everything = Window.partitionBy()
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.array(*[F.lit(float(w)) for w in weights])[rank]
    t = by.select("source", "source_size", weight.alias("_w"), (F.lit(most) * F.col("source_size")).alias("_cap"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*", F.coalesce(F.sum("_cap").over(order), F.lit(0.0)).alias("_full"), F.coalesce(F.sum("_w").over(order), F.lit(0.0)).alias("_gone"),
        F.sum("_w").over(everything).alias("_all_w"), F.sum("source_size").over(everything).alias("_all"),
    )
    # the level of the rest if the sources before this one are full: it rises as long as they are, and then falls
    t = t.withColumn("_level", (F.lit(share) * F.col("_all") - F.col("_full")) / (F.col("_all_w") - F.col("_gone")))
    return t.select("source", "source_size", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_w")).alias("target"))


def tilted(dual: Column, size: Column, mean: Column, most: float) -> Column:
    """The rate of a document; sizes of 0 have none."""
    return F.when(size > 0, F.exp(F.least(dual * size / mean, F.lit(math.log(most))))).otherwise(0.0)


def solved(sizes: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """source, mean (of its documents' sizes) and dual. sizes: source, size and n, documents of that size; goals: source and target."""
    of = sizes.filter("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    start = goals.join(named(of), F.col("source").eqNullSafe(F.col("_s"))).select("source", "target", "source_size", "mean")
    # all rates are `most` at `high`; at `low` no document gives more than exp(-40)
    high = F.lit(math.log(most)) * F.col("mean")
    dual = F.when(F.col("target") >= most * F.col("source_size"), high).otherwise(0.0)
    now = start.select("source", "target", "mean", dual.alias("dual"), (F.lit(-40.0) * F.col("mean")).alias("low"), high.alias("high"))
    now = common.cut(now)
    for _ in range(STEPS):
        rows = sizes.filter("size > 0").join(named(now), F.col("source").eqNullSafe(F.col("_s")))
        rate, x = tilted(F.col("dual"), F.col("size"), F.col("mean"), most), F.col("size") / F.col("mean")
        free = F.when(rate < most, rate).otherwise(0.0)
        sums = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("tokens"), F.sum(F.col("n") * F.col("size") * x * free).alias("slope"))
        step = now.join(named(sums), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        miss = F.log(F.greatest("tokens", F.lit(1e-300)) / F.greatest("target", F.lit(1e-300)))  # Newton on the logarithm, which is nearly straight
        low, high = F.when(miss < 0, F.col("dual")).otherwise(F.col("low")), F.when(miss > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - miss * F.try_divide(F.col("tokens"), F.col("slope"))
        # the bounds close in on the solution; outside them, or without a slope, the middle is taken
        near = step.select("source", "target", "mean", F.abs(miss).alias("miss"), "dual", low.alias("low"), high.alias("high"), newton.alias("_newton"))
        inside = F.col("_newton").isNotNull() & (F.col("_newton") >= F.col("low")) & (F.col("_newton") <= F.col("high"))
        after = F.when(F.col("miss") <= CLOSE, F.col("dual")).when(inside, F.col("_newton")).otherwise((F.col("low") + F.col("high")) / 2)
        now = common.cut(near.select("source", "target", "mean", "miss", after.alias("dual"), "low", "high"), now)
        if (now.agg(F.max(F.when((F.col("high") - F.col("low")) > 1e-9 * F.col("mean"), F.col("miss")))).first()[0] or 0) <= CLOSE:
            break
    return now.select("source", "mean", "dual")


def named(by_source: DataFrame) -> DataFrame:
    return by_source.withColumnRenamed("source", "_s")


def blocks_of(sizes: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """source, size, range, rate and before: what a document's copies follow from, for each block. sizes: source, size, range, tier and n."""
    by_size = common.cut(sizes.groupBy("source", "size").agg(F.sum("n").alias("n")))
    duals = solved(by_size, goals, most)
    rows = sizes.join(named(duals), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = common.cut(rows.select("source", "size", "range", "tier", "n", tilted(F.col("dual"), F.col("size"), F.col("mean"), most).alias("rate")), by_size)
    carry, done, out = None, [], None
    for tier in range(len(TIERS)):
        common.tidy(sizes.sparkSession)
        part = rows.filter(F.col("tier") == tier)
        wanted = part.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("wanted"))
        if carry is None:
            wanted = wanted.withColumn("carry", F.lit(0.0))
        else:
            wanted = wanted.join(named(carry), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["carry"])
        scale = F.when(F.col("wanted") > 0, F.greatest(F.lit(0.0), (F.col("wanted") + F.col("carry")) / F.col("wanted"))).otherwise(1.0)
        part = part.join(named(wanted.select("source", scale.alias("scale"))), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        part = part.withColumn("rate", F.least(F.lit(most), F.col("rate") * F.col("scale")))
        order = Window.partitionBy("source").orderBy(F.desc("size"), "range").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(order), F.lit(0.0)))
        part = common.cut(part.select("source", "size", "range", "n", "rate", "before"))
        done.append(part)
        out = part if out is None else out.unionByName(part)
        if tier + 1 < len(TIERS):
            taken = part.groupBy("source").agg(F.sum((whole(F.col("before") + F.col("n") * F.col("rate")) - whole(F.col("before"))) * F.col("size")).alias("taken"))
            missed = wanted.join(named(taken), F.col("source").eqNullSafe(F.col("_s"))).select("source", (F.col("wanted") + F.col("carry") - F.col("taken")).alias("carry"))
            if carry is not None:  # sources without documents in this tier
                missed = missed.unionByName(carry.join(named(missed.select("source")), F.col("source").eqNullSafe(F.col("_s")), "left_anti"))
            carry = common.cut(missed)
            done.append(carry)
    out = common.cut(out, rows)
    common.drop(*done)
    return out


def whole(x: Column) -> Column:
    return F.floor(x + 1e-7)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies times size) and the columns to keep, a row for each of docs."""
    tier = F.lit(len(TIERS))
    for i in reversed(range(len(TIERS))):
        tier = F.when(F.col("size") >= TIERS[i], i).otherwise(tier)
    rows = common.cut(sized(docs, keep).withColumn("_range", F.shiftright("_order", 64 - RANGES.bit_length() + 1)))
    sizes = rows.groupBy("source", "size", F.col("_range").alias("range")).agg(F.count("*").alias("n")).withColumn("tier", tier)
    sizes = common.cut(sizes)
    goals = common.cut(targets(sizes.groupBy("source", "size").agg(F.sum("n").alias("n")), weights, share, most))
    blocks = blocks_of(sizes, goals, most)
    common.tidy(docs.sparkSession)
    places = blocks.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("range").alias("_v"), "rate", "before")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_range") == F.col("_v"))
    out = rows.join(places, same, "left").drop("_s", "_z", "_v")
    place = Window.partitionBy("source", "size", "_range").orderBy("_order", "doc_id")
    out = out.withColumn("_place", F.row_number().over(place))
    steps = whole(F.col("before") + F.col("_place") * F.col("rate")) - whole(F.col("before") + (F.col("_place") - 1) * F.col("rate"))
    out = out.withColumn("copies", F.coalesce(F.least(F.lit(math.ceil(most)).cast("long"), steps), F.lit(0).cast("long")))
    out = out.join(F.broadcast(named(goals)) if goals.count() <= common.FEW else named(goals), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
