"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of the class [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: A word: a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """The text with A-Z alone put in lower case."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the parts alone: 52 bits of their MD5 digest."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Without that setting a temporary folder serves, in local mode only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="bathyal-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def passing(spark: SparkSession, path: str) -> None:
    """Has the path removed when the session's file system closes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Jobs that run inside hand n rows at a time to Python, so that batches of long texts stay small on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again, which cuts its lineage.

    The table outlives lost executors. It is removed when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: A table that is looked up is broadcast up to so many rows, and beyond that met under SALTS salts.
BROADCAST_ROWS = 4096
SALTS = 16


def lookup(rows: DataFrame, table: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """rows with the columns of a table that has one row for each key, null where it has none. No key has nulls; many rows may
    share one: they are spread over salts unless the table is small."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, "left")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(table.select("*", salts), [*on, "salt"], "left").drop("salt")


#: Numbers of a flat array that are summed up together.
BLOCK = 1 << 16
BLOCKS = "block int, part int, weight double, values binary"


def blocks_of(values: np.ndarray, weight: float, part: int) -> pa.RecordBatch:
    """A flat array as rows of BLOCKS, for block_sums."""
    flat = np.ascontiguousarray(values, np.float64).ravel()
    pieces = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
    n = len(pieces)
    columns = [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, float(weight))), pa.array(pieces, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "part", "weight", "values"])


def block_sums(parts: DataFrame) -> tuple[float, np.ndarray] | None:
    """The sum of all parts' weights and of their arrays, which come as rows of BLOCKS; None without any part.

    A tree: each block is first summed over about the square root of all parts at a time, then over these sums, so no task
    gets more than that many pieces. The driver gets one array.
    """

    def added(keys: list[str]):
        def add(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(rows["values"].iloc[0]) // 8)
            for raw in rows["values"]:
                total += np.frombuffer(raw)
            return rows.iloc[:1][keys].assign(weight=rows["weight"].sum(), values=[total.tobytes()])

        return add

    branches = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    first = parts.withColumn("branch", F.col("part") % branches).groupBy("block", "branch")
    first = first.applyInPandas(added(["block", "branch"]), "block int, branch int, weight double, values binary")
    rows = first.groupBy("block").applyInPandas(added(["block"]), "block int, weight double, values binary").collect()
    rows.sort(key=lambda r: r["block"])
    return (rows[0]["weight"], np.concatenate([np.frombuffer(r["values"]) for r in rows])) if rows else None
