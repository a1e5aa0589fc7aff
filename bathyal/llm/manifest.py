"""A Merkle manifest of a dataset by superblock reduction.

Each row is a leaf; the leaves of a tree (the rows of one source) stand in order of a key. A leaf's index within its tree
comes from a range partitioning and the ranges' counts. Leaves fall into buckets of fanout**levels consecutive indices; one
group of `applyInPandas` collapses that many levels of a bucket at once and gives every leaf its siblings on the way. Bucket
roots are reduced in the same way until each tree has one node, the roots of all trees are reduced like leaves of one more
tree, and on the way back each bucket's siblings above are put behind the siblings below. Ten rounds of five levels hold
3**50 rows. No group has more than fanout**levels nodes, whatever share of the rows a source has.

Rules: H is the lowercase hex SHA-256 of its inputs, one after another, digests as hex text. While a tree has more than one
node, each run of `fanout` consecutive nodes becomes the H of the run; the last run may be shorter, even a single node.

Defined cases: a null value of any column is `-` in the leaf, and null sources are a tree of their own, before all others.
Null ids come first; rows that repeat one id stand in order of their leaves. An empty text is `0:`. A tree of one leaf has
that leaf as its root and no siblings. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import lookup, remainder, shuffle_partitions, stash

#: The columns of a leaf, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = ArrayType(StructType([StructField("before", StringType()), StructField("after", StringType())]))


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(**values: Column) -> Column:
    """H of the values, each `-` if null, else the number of its UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.sha2(F.concat(*parts), 256)


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes (tree, ...) with index, gapless from 0 in the given order within the tree, and n, the number of the tree's nodes."""
    spark = nodes.sparkSession
    ranged = nodes.repartitionByRange(shuffle_partitions(spark), "tree", *order).sortWithinPartitions("tree", *order)
    ranged = stash(ranged.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "ranged")
    counts = ranged.groupBy("part", "tree").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("k").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stash(counts.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("k").over(whole).alias("n")), "starts")
    met = lookup(ranged, starts, ["part", "tree"], F.col("id"))
    return met.withColumn("index", F.col("id") + F.col("shift")).drop("id", "part", "shift")


def _collapse(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def collapse(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("index")
        nodes, left = list(bucket["digest"]), int(bucket["n"].iloc[0])
        paths: list[list[dict]] = [[] for _ in nodes]
        bounds = list(range(len(nodes) + 1))  # the leaves below node i are bounds[i] to bounds[i + 1]
        for _ in range(levels):
            if left == 1:
                break
            above, ends = [], [0]
            for at in range(0, len(nodes), fanout):
                run = nodes[at : at + fanout]
                for k in range(len(run)):
                    step = {"before": "".join(run[:k]), "after": "".join(run[k + 1 :])}
                    for i in range(bounds[at + k], bounds[at + k + 1]):
                        paths[i].append(step)
                above.append(hashed("".join(run)))
                ends.append(bounds[at + len(run)])
            nodes, bounds, left = above, ends, -(-left // fanout)
        return bucket.drop(columns=["digest"]).assign(top=nodes[0], path=paths)

    return collapse


def ascended(nodes: DataFrame, fanout: int, levels: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes (tree, index, n, digest, more) with their path to the top and what `finish` adds for the whole tree.

    finish: gets tree and digest of the single node that each tree ends in, gives tree, path and columns of its own.
    """
    size = fanout**levels
    bucketed = nodes.withColumn("bucket", F.floor(F.col("index") / size).cast("long"))
    kept = bucketed.drop("digest")
    shape = StructType([*kept.schema.fields, StructField("top", StringType()), StructField("path", PATH)])
    lower = stash(bucketed.groupBy("tree", "bucket").applyInPandas(_collapse(fanout, levels), shape), "lower")
    fewer = F.ceil(F.col("n") / size).cast("long").alias("n")
    tops = lower.where(F.col("index") % size == 0).select("tree", F.col("bucket").alias("index"), fewer, F.col("top").alias("digest"))
    if tops.where("n > 1").isEmpty():
        upper = finish(tops.select("tree", "digest")).withColumn("bucket", F.lit(0).cast("long"))
    else:
        upper = ascended(tops, fanout, levels, finish).drop("n").withColumnRenamed("index", "bucket")
    own = [c for c in upper.columns if c not in ("tree", "bucket", "path")]
    met = lower.join(upper.withColumnRenamed("path", "rest"), ["tree", "bucket"])
    return met.select(*nodes.drop("digest").columns, F.concat("path", "rest").alias("path"), *own)


def tree_key(source: Column) -> Column:
    """A key without nulls that is in the order of the source's bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def manifest(leaves: DataFrame, fanout: int = 3, levels: int = 5) -> DataFrame:
    """doc_id, leaf and all other columns of `leaves` (source, doc_id, leaf, more), with index (within the source), path,
    subroot (of the source) and root.

    path: the siblings `before` and `after` the node in its run, level by level from the leaf through the subroot to the root.
    """

    def whole(subroots: DataFrame) -> DataFrame:
        trees = subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("own"), F.col("digest").alias("subroot"))
        numbered = placed(trees, ["own"]).withColumn("digest", F.col("subroot"))
        top = ascended(numbered, fanout, levels, lambda one: one.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root")))
        return top.select(F.col("own").alias("tree"), "path", "subroot", "root")

    kind = leaves.schema["doc_id"].dataType
    keyed = leaves.withColumn("tree", tree_key(F.col("source"))).drop("source")
    numbered = placed(keyed, ["doc_id", "leaf"])  # ids go through pandas as text, so that nulls don't turn them into floats
    numbered = numbered.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("digest", F.col("leaf"))
    found = ascended(numbered, fanout, levels, whole)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind)).drop("tree", "n")


def proof(path: Column) -> Column:
    """All siblings of a path, one after another."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf gives together with its path."""
    return F.aggregate(path, digest, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def tamper_check(docs: DataFrame, fanout: int = 3, levels: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: whether rows, of which those with an even CRC-32 of
    their id have lost all newlines of their text since, still give the root of the manifest. A null id counts as empty text."""
    even = remainder(F.col("doc_id"), 2) == 0
    now = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    again = leaf(**({c: F.col(c) for c in LEAF_COLUMNS} | {"text": now}))
    was = leaf(**{c: F.col(c) for c in LEAF_COLUMNS})
    made = manifest(docs.select("source", "doc_id", was.alias("leaf"), again.alias("leaf_now")), fanout, levels)
    checked = made.withColumn("folded_root", folded(F.col("path"), F.col("leaf_now")))
    return checked.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
