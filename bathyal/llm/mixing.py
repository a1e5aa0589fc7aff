"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the mix by weight, but at most `most` times its size; what is above is shared again
by weight. In a source whose target is r times its size, every document gets floor(r) whole copies for certain. The rest of
the target is a sample without replacement with unequal inclusion odds: a document of n words has the odds
p / (1 - p) * bits(n) / MIDDLE with p = r - floor(r), where bits(n) is the number of binary digits of n, so that long documents
are somewhat likelier than short ones. Documents are ranked by their random odds U / (1 - U) over these inclusion odds, and the
first ones whose words make up the rest are taken. The sample is fixed in words, so a source misses its target by half of one
document at most.

Ranks need no sort of a whole source: words are summed per (source, slice of the rank q, by q / (1 + q)), which gives each
slice its start, and only rows of one slice are ranked among themselves. U depends on the seed and doc_id alone, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order. Documents of size 0 take no
words. A source without words has target 0. Rows that repeat one doc_id in one source with one size are taken alike.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, uniform, word_count

SLICES = 4096
#: Binary digits of a document's size at which its inclusion odds are those of its source.
MIDDLE = 8.0


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target; sizes has source and size. A row per source is all that meets in one task.

    The fixed point of "cap, then reshare by weight" is target = min(cap, level * weight). Sources are taken in order of
    cap / weight; the level is what is left over the weight that is left, at the first source that it doesn't fill.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    ranked = sources.select("source", "source_size", weight.alias("weight"), cap.alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(rest)).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    level = F.coalesce(F.min(fits).over(whole)["level"], F.max(F.col("cap") / F.col("weight")).over(whole))
    return levels.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 10, slices: int = SLICES
) -> DataFrame:
    """doc_id, source, size, n_rows, source_size, target, copies: a row per document, n_rows times in docs."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = stash(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "sizes")
    targets = source_targets(sizes.select("source", (F.col("size") * F.col("n_rows")).alias("size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(
        _source_key(F.col("source")).alias("key"), "source_size", "target", F.floor(ratio).cast("double").alias("whole")
    )
    targets = targets.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    targets = targets.withColumn("p", F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(0.0))
    targets = stash(targets, "targets")

    u = uniform(F.lit(seed), F.col("doc_id"))
    bits = F.length(F.bin("size"))
    drawn = sizes.withColumns({"key": _source_key(F.col("source")), "u": u, "words": F.col("size") * F.col("n_rows")})
    drawn = drawn.join(targets, "key")
    odds = F.col("p") / (1 - F.col("p")) * bits / MIDDLE
    drawn = drawn.withColumn("rank", F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / odds).otherwise(F.col("u")))
    drawn = drawn.withColumn("slice", F.floor(F.col("rank") / (1 + F.col("rank")) * slices).cast("int"))
    per_slice = drawn.groupBy("key", "slice").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select("key", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("slice_start"))
    ranked = drawn.join(starts, ["key", "slice"])
    within = Window.partitionBy("key", "slice").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("words").over(within), F.lit(0))
    extra = (F.col("left") > 0) & (start + F.col("words") / 2 <= F.col("left"))
    return ranked.select(
        "doc_id", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + extra.cast("int")).cast("int").alias("copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    plan = mix_plan(docs, **options).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    match = docs["doc_id"].eqNullSafe(plan["__id"]) & docs["source"].eqNullSafe(plan["__source"]) & (word_count(docs["text"]) == plan["__size"])
    taken = docs.join(plan, match).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.drop("__id", "__source", "__size", "__copies", "__copy")
