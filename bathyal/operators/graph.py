"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows lie within these many cells of zero, columns within twice as many.
REACH = 1 << 29


def cell_id(row: Column, col: Column) -> Column:
    """A cell's number: one for each row and column within REACH."""
    return F.shiftleft(row.cast("long") + REACH, 32) + (col.cast("long") + 2 * REACH)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Without it a temporary folder serves, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="bathyal-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def passing_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the session's file system closes."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def saved(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share and read again, which cuts its lineage."""
    path = passing_folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component, the smallest id reachable. nodes: id; edges: a, b.

    Every round each node with a smaller neighbour points to the least of them, pointers double their reach until all end at a
    node without one, and edges are drawn again between such nodes. At most half of the nodes are left after a round, and edges,
    once each, travel once a round, not once a doubling. Joins are by merging, here and in `chained`: a table small enough to be
    broadcast would pass through the driver in every round.
    """
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = saved(edges.select("a", "b").where("a <> b").select(least, most).distinct())
    labels = nodes.select("id", F.col("id").alias("component"))
    while not left.isEmpty():
        up = saved(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")))
        while True:
            onward = up.select(F.col("id").alias("up"), F.col("up").alias("further"))
            stepped = saved(up.join(onward.hint("merge"), "up", "left").select("id", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
            up = stepped.drop("moved")
            if stepped.where("moved").isEmpty():
                break
        labels = saved(labels.join(up.select(F.col("id").alias("component"), "up").hint("merge"), "component", "left").select("id", F.coalesce("up", "component").alias("component")))
        for side in "ab":
            other = "b" if side == "a" else "a"
            left = left.join(up.withColumnRenamed("id", side).hint("merge"), side, "left").select(F.coalesce("up", side).alias(side), other)
        left = saved(left.where("a <> b").select(least, most).distinct())
    return labels


def chained(links: DataFrame) -> DataFrame:
    """id, chain, left, cycle: the chain that each link is in, named after its last link, and how many links follow in it.

    links: id and nxt (null at an end); no two links have the same nxt. A cycle is cut before its smallest id. Links learn of
    links twice as far in every round, so the number of rounds follows the logarithm of the longest chain, and no chain is ever
    in one task.
    """
    links = saved(links.select("id", "nxt"))
    now = saved(links.select("id", F.col("nxt").alias("jump"), F.col("id").alias("least")))
    while True:  # the smallest id ahead; the ways of open chains come to an end
        onward = now.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.col("least").alias("other"))
        live = now.where("jump IS NOT NULL").join(onward.hint("merge"), "jump")
        live = live.select("id", F.col("further").alias("jump"), F.least("least", "other").alias("least"), (F.col("further").isNull() | (F.col("other") < F.col("least"))).alias("moved"))
        stepped = saved(live.unionByName(now.where("jump IS NULL").withColumn("moved", F.lit(False))))
        now = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            break
    cut = links.join(now.select("id", F.col("jump").isNotNull().alias("cycle"), "least").hint("merge"), "id")
    cut = cut.select("id", F.when(~(F.col("cycle") & (F.col("nxt") == F.col("least"))), F.col("nxt")).alias("jump"), "cycle")
    state = cut.select("id", "jump", "cycle", F.coalesce("jump", "id").alias("chain"), F.col("jump").isNotNull().cast("long").alias("left"))
    now = saved(state)
    while not now.where("jump IS NOT NULL").isEmpty():
        onward = now.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.col("chain").alias("end"), F.col("left").alias("more"))
        live = now.where("jump IS NOT NULL").join(onward.hint("merge"), "jump")
        live = live.select("id", F.col("further").alias("jump"), "cycle", F.col("end").alias("chain"), (F.col("left") + F.col("more")).alias("left"))
        now = saved(live.unionByName(now.where("jump IS NULL")))
    return now.select("id", "chain", "left", "cycle")


def counted_off(rows: DataFrame, name: str = "k") -> DataFrame:
    """rows with their number from 1 in the order in which they are read. Each partition counts its own rows; the partitions'
    totals, a row for each, tell where each begins."""
    held = saved(rows.withColumn("__id", F.monotonically_increasing_id()))
    totals = held.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("__part", before.alias("__before"))
    placed = held.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(starts), "__part")
    number = F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn(name, number).drop("__id", "__part", "__before")
