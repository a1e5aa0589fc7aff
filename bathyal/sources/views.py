"""Survey-shaped views of the test tables: points, soundings, profiles, routes, surfaces and structures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("point_id"),
        (micros / 3.6e9).alias("x"),
        F.col("user_id").cast("double").alias("y"),
        F.col("value").alias("z"),
        F.array_position(kinds, F.col("event_type")).cast("int").alias("classification"),
        F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int").alias("intensity"),
    )


def soundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("point_id"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("x"),
        F.col("o_custkey").cast("double").alias("y"),
        (-F.col("o_totalprice") / 1000).alias("z"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("classification"),
    )


def vec3(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return _read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.col("label").alias("classification")
    )


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("structure_id"),
        F.col("s_name").alias("name"),
        (F.col("s_acctbal") / 100).alias("x"),
        F.col("s_nationkey").cast("double").alias("y"),
        F.lit(8.0).alias("diameter"),
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).select(F.col("y").cast("long").alias("route_id"), "point_id", F.col("x").alias("ch"), "z")


def route_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bathyal.operators.routes import with_chainage

    order = Window.partitionBy("y").orderBy("x", "point_id")
    rows = pts(spark, sf_dir).select(
        F.col("y").cast("long").alias("route_id"), F.row_number().over(order).alias("seq"), "x", F.col("z").alias("z0")
    )
    return with_chainage(rows.withColumnRenamed("z0", "y"))


def _cells(points: DataFrame, *keys: str) -> DataFrame:
    cells = points.withColumn("col", F.floor(F.col("x") / 30)).withColumn("row", F.floor(F.col("y") / 50))
    return cells.groupBy(*keys, "col", "row").agg(F.avg("z").alias("z"))


def epoch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = soundings(spark, sf_dir).withColumn("epoch", (F.col("point_id") % 2).cast("int"))
    return _cells(points, "epoch")


def seabed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(soundings(spark, sf_dir))
