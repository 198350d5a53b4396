"""Mixing sources to target weights by histograms of hashes.

Each source gets a target number of words. A source whose target is r times
its size gives every document floor(r) times, and those documents once more
whose hash lies under a threshold. The threshold comes from a histogram of
words by source and hash bucket: the bucket where the running sum meets the
budget is refined with the next bits of the hash, only its documents are
counted again, until a bucket is one hash value. Thresholds are nested: a
smaller budget takes a subset of the documents. Documents are never sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, materialize
from tessera.types import free_name

#: Bits of the hash that are used, and bits a level of the histogram looks at.
BITS, LEVEL = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_hash(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of the MD5 of the seed and the id: the same in any run and any engine. Null ids count as empty."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def _places(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with place: the source's place in order of code points, null last, from 0. Dealt by range, so no task has all sources."""
    order = F.col("source").asc_nulls_last()
    dealt = materialize(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("id", F.monotonically_increasing_id()), "mix-sources", 0)
    part = F.shiftright("id", 33)
    # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return dealt.withColumn("part", part).join(starts, "part").select("source", "source_size", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target for each row of sizes (source, source_size).

    Sources in order of code points, null last, weigh as weights say, again
    and again. share times the sum of all sizes is dealt out by weight; a
    target stops at most times its source's size and what is over goes to the
    others by weight, again until none is above: each time one sum over the
    sources. share must not exceed most.
    """
    if share > most:
        raise ValueError("more is to be dealt than the sources may give")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    cap = most * F.col("source_size")
    ranked = materialize(_places(sizes).select("source", "source_size", w.alias("weight"), cap.alias("cap"), (cap / w).alias("room")), "mix-ranked", 0)
    level = -1.0
    while True:  # the level only rises, and each time another source stops
        stops = F.col("room") < level
        r = ranked.agg(share * F.sum("source_size"), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))).first()
        new = (r[0] - (r[1] or 0.0)) / r[2] if r[2] else float("inf")
        if new == level or not r[2]:
            break
        level = new
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.lit(new) * F.col("weight")).alias("target"))


def _cut(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """source and cut: documents whose hash is less than cut are taken, so that their words come as near the source's budget as whole hash values allow.

    Level by level: a histogram of the documents in the source's open bucket,
    its running sums, and the bucket where they pass the budget.
    """
    state = budgets.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("low"), F.col("budget").cast("double").alias("left"))
    shift = BITS
    while shift > 0:
        shift -= LEVEL
        step = 1 << shift
        # small: one row a source; Spark broadcasts it if its size at run time allows
        # the open bucket: the hash without the bits below agrees with low
        inside = items.join(state, items["source"].eqNullSafe(state["s"]) & (F.shiftright(items["h"], shift + LEVEL) == F.shiftright(F.col("low"), shift + LEVEL)) & (F.col("left") > 0))
        hist = inside.groupBy("s", "low", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        by = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = hist.withColumn("upto", F.sum("words").over(by))
        # the first bucket that passes the budget; none passes: all are taken
        over = run.filter(F.col("upto") > F.col("left")).groupBy("s").agg(F.min(F.struct("bucket", "upto", "words")).alias("b"))
        found = state.alias("o").join(over.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left")
        rest = F.col("left") - (F.col("b.upto") - F.col("b.words"))
        if shift:
            low = F.when(F.col("left") <= 0, F.col("low")).when(F.col("b").isNull(), F.col("low") + F.lit(step << LEVEL)).otherwise(F.col("b.bucket") * F.lit(step))
            left = F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(rest)
        else:  # the hash value that passes is taken if that comes nearer
            low = F.when(F.col("left") <= 0, F.col("low")).when(F.col("b").isNull(), F.col("low") + F.lit(step << LEVEL)).otherwise(F.col("b.bucket") + F.when(2 * rest >= F.col("b.words"), 1).otherwise(0))
            left = F.lit(0.0)
        state = materialize(found.select("s", low.cast("long").alias("low"), left.alias("left")), "mix-cut", 0)
    return state.select(F.col("s").alias("source"), F.col("low").alias("cut"))


def mix_plan(items: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source of items (source, size, h): plan_source, source_size, target, whole (copies of every document) and cut (one more for hashes below)."""
    goal = targets(items.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = materialize(goal, "mix-goal", 0)
    cut = _cut(items, goal)
    plan = goal.join(cut.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return materialize(plan.select(F.col("source").alias("plan_source"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "mix-plan", 0)


def _copies(h: Column) -> Column:
    return (F.col("whole") + F.when(h < F.col("cut"), 1).otherwise(0)).cast("long")


def _items(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), unit_hash(F.col("doc_id"), seed).alias("h"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of docs.

    docs: doc_id, text and source; other columns are ignored. A null text has
    size 0. A null source is a source of its own, the last. Rows with one
    doc_id share a hash and are taken together. Empty sources (size 0) get
    target 0. The same rows give the same result in any run and order.
    """
    items = materialize(_items(docs, seed), "mix-items")  # no texts: some numbers a document
    out = items.join(mix_plan(items, weights, share, most), F.col("source").eqNullSafe(F.col("plan_source")), "left")
    return out.withColumn("copies", _copies(F.col("h"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of docs that mix takes, with their columns, whatever their names, as often as it takes them; rows without words go. An empty table gives no rows."""
    own = free_name(docs)
    plan = mix_plan(materialize(_items(docs, seed), "mix-items"), weights, share, most).select(*[F.col(c).alias(f"{own}{c}") for c in ("plan_source", "whole", "cut")])
    out = docs.join(plan, F.col("source").cast("string").eqNullSafe(F.col(f"{own}plan_source")), "left")
    n = F.col(f"{own}whole") + F.when(unit_hash(F.col("doc_id"), seed) < F.col(f"{own}cut"), 1).otherwise(0)
    out = out.withColumn(f"{own}n", F.when(word_count(F.col("text").cast("string")) > 0, n).otherwise(0).cast("int")).filter(F.col(f"{own}n") > 0)
    return out.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}n")))).select(*[F.col(f"`{c}`") for c in docs.columns])
