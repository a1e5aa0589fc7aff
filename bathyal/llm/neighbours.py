"""Approximate nearest neighbours by inner product, with collision-counting hashing.

Vectors are scaled to the largest norm and given one coordinate more that makes all norms equal; queries are scaled to norm
one. Distances then fall as inner products rise. Each of PROJECTIONS random directions keeps a block's vectors in a sorted
array. A query opens a window around its own projection in every array; virtual rehashing widens the windows by a
factor GROWTH at a time, or by less if the k-th best tells how wide they must be. Vectors that lie in at least THRESHOLD of the windows are verified:
their inner products are computed exactly. A query is done when any vector nearer than its k-th best would have passed the
threshold by CONFIDENCE standard deviations, or when every vector has been verified.

Rows are dealt out in blocks of about BLOCK vectors and queries in chunks of about CHUNK; each (block, chunk) is one task's
group, whose size doesn't depend on the data, and yields k rows per query. These meet once more to give the best k.

Defined cases: vectors that are null or zero, or hold a null or a component that isn't finite, take no part, nor do vectors
whose length isn't the most frequent one (the larger among equals), nor rows without an id. Equal scores rank by the smaller
id. Of rows that repeat an id each is a candidate, but for a query no row with its own id is; of rows that repeat a query's id
the least vector asks. Inner products beyond the range of doubles are infinite and rank as such. Fewer candidates than k are
all returned. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

PROJECTIONS, THRESHOLD, GROWTH, CONFIDENCE = 64, 0.6, 1.5, 1.0
#: What rounding can change in a product of vectors of norm one at most.
SLACK = 1e-12
BLOCK, CHUNK = 1 << 13, 1 << 9
FIRST_WIDTH = 0.25
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda c: c != 0))
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length"))
    most = lengths.first()
    return rows.where(F.size("embedding") == (most["length"] if most else 0))


def directions(dimensions: int) -> np.ndarray:
    """PROJECTIONS columns, orthogonal in groups of `dimensions`, each of the length that a normal vector has on average."""
    rng = np.random.default_rng(5)
    turns = [np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0] for _ in range(math.ceil(PROJECTIONS / dimensions))]
    return np.hstack(turns)[:, :PROJECTIONS] * math.sqrt(dimensions)


def _reach() -> float:
    """How many times the distance a window's half width must be for a vector to pass the threshold with CONFIDENCE."""
    share = lambda w: math.erf(w / math.sqrt(2))  # noqa: E731  of projections whose difference is below w distances
    low, high = 0.0, 8.0
    for _ in range(60):
        w = (low + high) / 2
        p = share(w)
        enough = PROJECTIONS * p - CONFIDENCE * math.sqrt(PROJECTIONS * p * (1 - p)) >= THRESHOLD * PROJECTIONS
        low, high = (low, w) if enough else (w, high)
    return high


REACH = _reach()


class Block:
    """Vectors of one block with a sorted array for each projection."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, peak: float, largest: float):
        """peak: the largest component of all vectors; largest: the largest norm of all vectors over peak. Vectors are divided
        by one after the other, so that no square can overflow."""
        self.ids, self.vectors = ids, vectors
        self.units = vectors / peak / largest
        lifted = np.hstack([self.units, np.sqrt(np.maximum(0, 1 - (self.units**2).sum(axis=1)))[:, None]])
        self.turn = directions(lifted.shape[1])
        places = (lifted @ self.turn).T
        order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, order, axis=1)
        #: Each vector's place in each sorted array: it lies in a window if its place is in the window's range of places.
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.place = np.empty(order.shape, kind)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=kind)[None, :], axis=1)

    def nearest(self, query_id: int, query: np.ndarray, k: int, width: float = FIRST_WIDTH) -> tuple[np.ndarray, np.ndarray, float]:
        """The best k with their scores, and how wide the windows became. width: of the first windows."""
        unit = query / np.abs(query).max()
        unit /= math.sqrt(float(unit @ unit))
        centre = np.append(unit, 0.0) @ self.turn
        need = math.ceil(THRESHOLD * PROJECTIONS)
        known = self.ids == query_id
        best_rows, best = np.zeros(0, np.int64), np.zeros(0)
        while not known.all():
            ranges = np.array([line.searchsorted((c - width, c + width)) for line, c in zip(self.sorted, centre, strict=True)])
            low, length = (part.astype(self.place.dtype) for part in (ranges[:, :1], ranges[:, 1:] - ranges[:, :1]))
            counts = ((self.place - low) < length).view(np.uint8).sum(axis=0, dtype=np.uint8)  # a place below `low` wraps round
            new = np.flatnonzero((counts >= need) & ~known)
            if len(new):
                known[new] = True
                if len(new) > 4 * k:  # a product of scaled vectors tells which ones can be among the best
                    near = self.units @ unit if 4 * len(new) > len(known) else None
                    near = near[new] if near is not None else self.units[new] @ unit
                    new = new[near >= np.partition(near, len(near) - k)[len(near) - k] - SLACK]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.nan_to_num(np.einsum("ij,j->i", self.vectors[new], query), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                best_rows, best = np.append(best_rows, new), np.append(best, scores)
                keep = np.lexsort((self.ids[best_rows], -best))[:k]
                best_rows, best = best_rows[keep], best[keep]
            if len(best) >= k:
                distance = math.sqrt(max(0.0, 2 - 2 * float(self.units[best_rows[k - 1]] @ unit)))
                if REACH * distance <= width:
                    break
                width = min(width * GROWTH, REACH * distance)
            else:
                width *= GROWTH
        return self.ids[best_rows], best, width

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        """Queries in order of their ids; the first windows of each are narrower by one step than the last ones of the query before."""
        order, found, width = np.argsort(query_ids, kind="stable"), [], FIRST_WIDTH
        query_ids = query_ids[order]
        for i, q in zip(query_ids.tolist(), queries[order], strict=True):
            found.append(self.nearest(i, q, k, width))
            width = max(FIRST_WIDTH, found[-1][2] / GROWTH)
        return pd.DataFrame(
            {
                "query_id": np.repeat(query_ids, [len(f[0]) for f in found]),
                "vec_id": np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64),
                "score": np.concatenate([f[1] for f in found]) if found else np.zeros(0),
            }
        )


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by `every`."""
    rows = stash(usable(vectors), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    n, peak = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, c: s + (c / peak) * (c / peak))
    largest = rows.agg(F.sqrt(F.max(squares))).first()[0] if n else 1.0
    blocks, chunks = math.ceil(n / BLOCK) or 1, math.ceil(queries.count() / CHUNK) or 1
    part = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.withColumn("block", part(blocks, 1)).withColumn("chunk", each(chunks))
    right = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("chunk", part(chunks, 2)).withColumn("block", each(blocks))

    def searched(_: tuple, block: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(chunk):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = Block(block["vec_id"].to_numpy(np.int64), np.vstack(block["embedding"].to_numpy()), peak, largest)
        return index.search(chunk["vec_id"].to_numpy(np.int64), np.vstack(chunk["embedding"].to_numpy()), k)

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(searched, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # k rows per block at most
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
