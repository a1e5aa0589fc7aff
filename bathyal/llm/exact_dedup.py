"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z. A digest only says which texts may be equal; every merge compares
the whole text:

1. Locally: each task combines the equal texts of CHUNK_BYTES at a time, before anything is shuffled, and marks one row of
   each local class as its head. A group with a third of all rows leaves one head for each chunk.
2. By salt: heads whose digest several heads have are dealt out by (digest, salt), where the salt is one of SALTS by the
   head's number, for every such digest alike, and equal texts are combined to one winner for each salt.
3. Globally: the winners of all salts are combined. Heads find their class again by (digest, salt), rows by their head.

Defined cases: null text counts as empty, and empty texts are copies of each other. The largest doc_id stays, null ids lose
to all others. Rows that repeat one doc_id with one text are marked alike by `exact_dedup`; `keep_one_of_each` keeps just
one row of each class, with or without an id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, UPPER, ascii_lower, stash

CHUNK_BYTES = 32 << 20
SALTS = 16
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _classes(ids: list, texts: list[bytes | None], first: int, digest_bytes: int) -> tuple[list, ...]:
    """For each row: SHA-256 of its text, the number of its local class (from `first`), whether it is that class's head, the
    head's id and the class's size."""
    shas, own, heads, sizes = [], [], [], []
    held: dict[bytes, list[tuple[bytes, int]]] = {}
    for row, (i, text) in enumerate(zip(ids, texts, strict=True)):
        text = (text or b"").translate(_TO_LOWER)
        sha = hashlib.sha256(text).digest()
        same = held.setdefault(sha[:digest_bytes], [])
        at = next((k for other, k in same if other == text), None)
        if at is None:
            same.append((text, at := len(heads)))
            heads.append(row)
            sizes.append(0)
        elif i is not None and (ids[heads[at]] is None or i > ids[heads[at]]):
            heads[at] = row
        sizes[at] += 1
        shas.append(sha)
        own.append(at)
    return shas, [first + k for k in own], [heads[k] == row for row, k in enumerate(own)], [ids[heads[k]] for k in own], [sizes[k] for k in own]


def combined_locally(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """docs, of which it needs doc_id and text, with sha, local, head, local_keep and local_size for each row."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, TaskContext.get().partitionId() << 33

        def chunk() -> Iterator[pa.RecordBatch]:
            nonlocal first
            table = pa.Table.from_batches(held)
            ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist()
            sha, own, head, keep, n = _classes(ids, texts, first, digest_bytes)
            first = max(own, default=first - 1) + 1
            at = 0
            for batch in held:
                part = slice(at, at := at + batch.num_rows)
                more = [pa.array(sha[part], pa.binary()), pa.array(own[part], pa.int64()), pa.array(head[part], pa.bool_()), pa.array(keep[part], batch.column("doc_id").type), pa.array(n[part], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sha", "local", "head", "local_keep", "local_size"])

        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= CHUNK_BYTES:
                yield from chunk()
                held, size = [], 0
        if held:
            yield from chunk()

    kind = docs.schema["doc_id"].dataType
    shape = StructType(list(docs.schema.fields)).add("sha", "binary").add("local", "long").add("head", "boolean").add("local_keep", kind).add("local_size", "long")
    return stash(docs.mapInArrow(combine, shape), "local")


def global_classes(local: DataFrame, digest_bytes: int) -> DataFrame:
    """local, keep_id, keep_local and group_size for each head whose digest other heads have too."""
    salt = F.pmod(F.xxhash64("local"), F.lit(SALTS)).cast("int")
    heads = local.where("head").select("doc_id", "text", "local", "local_size", F.substring("sha", 1, digest_bytes).alias("digest"), salt.alias("salt"))
    repeated = stash(heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "repeated")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    met = heads.join(repeated.select("digest", salts).hint("shuffle_hash"), ["digest", "salt"], "left_semi")
    met = met.withColumn("norm", ascii_lower(F.coalesce("text", F.lit(""))))
    winners = met.groupBy("digest", "salt", "norm").agg(F.max(F.struct("doc_id", "local")).alias("winner"), F.sum("local_size").alias("n"))
    classes = winners.groupBy("digest", "norm").agg(F.max("winner").alias("winner"), F.sum("n").alias("group_size"))
    classes = stash(classes.select("digest", "norm", F.col("winner.doc_id").alias("keep_id"), F.col("winner.local").alias("keep_local"), "group_size"), "classes")

    thin = heads.select("local", "digest", "salt")
    collided = classes.groupBy("digest").count().where("count > 1").select("digest")
    if collided.isEmpty():
        return thin.join(classes.drop("norm").select("*", salts), ["digest", "salt"]).drop("digest", "salt")
    clear = classes.join(collided, "digest", "left_anti")  # different texts with one digest: their heads find their class by the text
    one = thin.join(clear.drop("norm").select("*", salts), ["digest", "salt"]).drop("digest", "salt")
    other = met.join(collided, "digest", "left_semi").select("local", "digest", "norm").join(classes, ["digest", "norm"]).drop("digest", "norm")
    return one.unionByName(other)


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, for each row of docs.

    digest_bytes: how much of the SHA-256 digest tells groups apart; results don't depend on it.
    """
    local = combined_locally(docs.select("doc_id", "text"), digest_bytes)
    rows = local.select("doc_id", "sha", "local", "local_keep", "local_size").join(global_classes(local, digest_bytes).drop("keep_local"), "local", "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("local_keep")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", "local_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one_of_each(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row of docs for each class of equal texts, with all its columns: the one with the largest doc_id."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else []))
    local = combined_locally(rows, digest_bytes)
    lost = global_classes(local, digest_bytes).where("local <> keep_local").select("local")
    column = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c)
    return local.where("head").join(lost, "local", "left_anti").select(*map(column, docs.columns))
