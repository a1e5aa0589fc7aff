from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from bathyal.sources import las

XYZ = "x double, y double, z double"


def read(spark, path):
    las.register(spark)
    return spark.read.format("las").load(str(path))


def test_rows_without_heights_are_left_out(spark, tmp_path):
    rows = [(0.0, 0.0, 1.0), (1.0, 1.0, math.nan), (2.0, 2.0, None), (3.0, math.inf, 3.0), (4.0, 4.0, -7.25)]
    las.write_las(spark.createDataFrame(rows, XYZ).coalesce(1), str(tmp_path / "a"))
    assert [tuple(r) for r in read(spark, tmp_path / "a").select("x", "y", "z").collect()] == [(0, 0, 1), (4, 4, -7.25)]


@pytest.mark.parametrize("most, factor", [(60_000, 1), (255, 257)])
def test_colours_are_widened_for_the_whole_cloud_or_not_at_all(spark, tmp_path, most, factor):
    rows = [(float(i), 0.0, 0.0, 200 if i < 50 else most, 7, 0) for i in range(100)]
    cloud = spark.createDataFrame(rows, f"{XYZ}, r int, g int, b int").repartitionByRange(4, "x")
    las.write_las(cloud, str(tmp_path / "a"))
    got = read(spark, tmp_path / "a").orderBy("x").select("r", "g", "b").collect()
    assert [tuple(r) for r in got] == [(r * factor, g * factor, 0) for _, _, _, r, g, _ in rows]


def test_overwrite_replaces_append_adds_and_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    cloud = spark.range(40).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    las.write_las(cloud.repartition(4), path)
    las.write_las(cloud.limit(1), path, mode="overwrite")
    assert read(spark, path).count() == 1
    las.write_las(cloud.limit(3), path)
    assert read(spark, path).count() == 4
    bad = cloud.withColumn("z", F.when(F.col("x") > 38, F.raise_error(F.lit("broken"))).otherwise(F.col("z")))
    with pytest.raises(Exception, match="broken"):
        bad.repartition(3).write.format("las").mode("overwrite").save(path)
    assert read(spark, path).count() == 4 and all(n.endswith(".las") for n in os.listdir(path))
    with pytest.raises(Exception, match="larger scale"):
        las.write_las(cloud.withColumn("x", F.col("x") * 1e9), path)


def test_only_asked_columns_and_records(spark, tmp_path):
    path = str(tmp_path / "a")
    cloud = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") / 7).alias("y"), F.lit(2.5).alias("z"), (F.col("id") % 4).cast("int").alias("classification"))
    las.write_las(cloud.repartitionByRange(5, "x"), path)
    few = las.columns(spark, path, ["x", "classification"])
    assert few.columns == ["x", "classification"] and few.agg(F.sum("x"), F.sum("classification")).first() == (499500, 1500)
    assert "BatchScan las[x#" in few._jdf.queryExecution().executedPlan().toString()
    found = las.columns(spark, path, ["x"], [("x", ">=", 990), ("classification", "=", 3), ("x", "<", 997.5)])
    assert found.columns == ["x"] and sorted(r.x for r in found.collect()) == [991, 995] and few.count() == 1000
    assert len(las.LasReader(path, few.schema, [("x", ">", 990)]).partitions()) == 1  # four of five files lie apart by their boxes
    assert las.columns(spark, path, ["x"], [("x", ">", 2000)]).count() == 0
    assert las.columns(spark, path, ["x"], [("gps_time", ">", 0)]).count() == 0  # no file has it


def test_point_ids_do_not_depend_on_pruning(spark, tmp_path):
    path = str(tmp_path / "a")
    cloud = spark.range(300).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    las.write_las(cloud.repartitionByRange(3, "x"), path)
    every = {r.x: r.point_id for r in read(spark, path).select("x", "point_id").collect()}
    assert sorted(every.values()) == list(range(300))
    assert all(every[r.x] == r.point_id for r in las.columns(spark, path, ["point_id", "x"], [("x", ">", 250)]).collect())


def test_extra_bytes_and_reference_systems(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [(float(i), 1.0, 2.0, i / 3, -i, "text") for i in range(50)] + [(99.0, 1.0, 2.0, None, 5, None)]
    cloud = spark.createDataFrame(rows, f"{XYZ}, `sigma z` double, `user-data!` long, name string")
    las.write_las(cloud.coalesce(1), path, epsg=3826)
    back = read(spark, path)
    assert back.columns[-2:] == ["sigma_z", "user_data_"]
    got = back.orderBy("x").collect()
    assert [r.user_data_ for r in got] == [*(-float(i) for i in range(50)), 5] and [r.sigma_z for r in got[:50]] == [i / 3 for i in range(50)] and math.isnan(got[50].sigma_z)
    header = las.read_header(las.las_files(path)[0])
    assert header["epsg"] == 3826 and header["length"] == 20 + 16
    las.write_las(cloud.coalesce(1), str(tmp_path / "b"), extra=[], wkt='PROJCS["x"]', version="1.4")
    other = las.read_header(las.las_files(str(tmp_path / "b"))[0])
    assert other["wkt"] == 'PROJCS["x"]' and other["extra"] == [] and other["format"] == 6
    assert las.extra_names(["a b", "a_b", "intensity", "é" * 40, ""]) == {"a b": "a_b", "a_b": "a_b_1", "intensity": "intensity_1", "é" * 40: "_" * 32, "": "extra"}


def test_copies_keep_all_fields_and_upgrade_classes(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    rows = [(float(i), i / 2, -i / 4, i, 2, 1 + i % 3, 3, 1000.5 + i, 10 * i, 20, 30, float(i % 30 - 15), 9, 77, i % 2, i * 1.5) for i in range(100)]
    shape = f"{XYZ}, intensity int, classification int, return_number int, number_of_returns int, gps_time double, r int, g int, b int, scan_angle double, user_data int, point_source_id int, flags int, depth double"
    las.write_las(spark.createDataFrame(rows, shape).coalesce(2), a, colour_factor=1)
    assert {las.read_header(p)["format"] for p in las.las_files(a)} == {3}
    new = read(spark, a).where("x < 5").select("point_id", F.lit(64).alias("classification"))
    las.copy_las(spark, a, b, new, "x <> 50")
    assert {las.read_header(p)["format"] for p in las.las_files(b)} == {7}
    names = [c.split()[0] for c in shape.split(", ")]
    got = sorted(tuple(r) for r in las.columns(spark, b, names).collect())
    want = [(*r[:4], 64 if r[0] < 5 else 2, *r[5:]) for r in rows if r[0] != 50]
    assert all(p == pytest.approx(q, abs=0.0035) for p, q in zip(got, want, strict=True))


def test_missing_files_and_columns(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        read(spark, tmp_path / "nowhere").count()
    with pytest.raises(Exception, match="need columns"):
        spark.range(3).withColumnRenamed("id", "x").write.format("las").mode("append").save(str(tmp_path / "c"))
    (tmp_path / "d.las").write_bytes(b"LASX" + bytes(400))
    with pytest.raises(Exception, match="no LAS file"):
        read(spark, tmp_path / "d.las").count()
    las.write_las(spark.createDataFrame([], XYZ), str(tmp_path / "e"))
    assert read(spark, tmp_path / "e").count() == 0
