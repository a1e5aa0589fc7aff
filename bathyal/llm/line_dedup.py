"""Line deduplication with DataFrame functions only.

Lines are exploded with their position, normalised and hashed; distinct documents are counted per hash (in two steps, so a
line that a third of all documents hold is counted in parts); lines over the threshold lose all but the largest document's
copies; texts are put together again by position. Lines are exploded and hashed once; only their 16-byte hashes are shuffled
to count and to find lines. A hash meets its count under SALTS salts, so no line is one task's. A text travels once, to meet
the list of its dropped positions.

Defined cases: a null or empty text is one empty line. Lines of documents without an id count for no document and are only
dropped when five others hold them. Rows that repeat one doc_id count as one document. An empty table gives an empty
result. Other columns are ignored. Two keys count as one line only if 128 bits of SHA-256 agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, stash

SALTS = 16


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, text_hash, dropped: the 0-based positions that go, for documents that lose lines."""
    keyed = docs.select("doc_id", "text_hash", F.posexplode(F.transform(F.split("text", "\n", -1), line_key)).alias("pos", "key"))
    lines = keyed.where(F.length("key") >= min_chars).select(
        "doc_id", "text_hash", "pos", F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("hash")
    )
    lines = stash(lines, "lines")
    common = (
        lines.groupBy("hash")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_id"))
        .where(F.col("n_docs") >= min_docs)
        .select("hash", "last_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    return (
        salted.join(common, ["hash", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list("pos").alias("dropped"))
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text, for each row of docs."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    gone = dropped_positions(texts, min_chars, min_docs).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "dropped"
    )
    match = texts["doc_id"].eqNullSafe(gone["gone_id"]) & (texts["text_hash"] == gone["gone_hash"])
    lines = F.split("text", "\n", -1)
    positions = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_except(positions, F.col("dropped"))
    joined = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    return (
        texts.join(gone, match, "left")
        .select("doc_id", "text", "dropped", lines.alias("lines"))
        .select(
            "doc_id",
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size(F.array_distinct("dropped")), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(joined).alias("kept_text"),
        )
    )
