"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

1. A text becomes its set of distinct word shingles. SAMPLES minima of hashed shingles form BANDS bands of ROWS minima; texts
   that agree in a band are candidates. At a similarity of 0.8 a pair fails to meet in any band once in a million.
2. The minima are also folded into an odd sketch: minimum i toggles one bit of a bitmap, so minima that two texts share
   cancel out and the population count of the XOR tells how many they don't share. A second odd sketch takes all shingles;
   with the sets' sizes it is sharper for texts of up to some thousand words. Candidates that either sketch puts more than
   MARGIN standard deviations below the threshold are dropped; sketches are precise where similarities are high.
3. What remains is confirmed on the full sets of both texts.

Groups need no pairs of all members. Texts with one set are one class, and only its first document goes on. In each band
bucket two leaders, the smallest id and the one in the fullest buckets, meet all members: a number of pairs that is linear in
the rows. Connected components of the confirmed links follow. Only buckets whose members are still in different components
hold links that could matter; their members outside the bucket's largest component then meet all others, in blocks of BLOCK
members. There a pair is looked at in the first band that it shares, if it isn't connected yet and its sketches are near. Only
members of such pairs get their full sets (64-bit hashes of all shingles), which each block's task compares; it returns the
links that connect its members, fewer than it has members. All links, those within a class among them, are confirmed on words.

Defined cases: a text with fewer words than a shingle is one shingle; without words its set is empty and it links with
nothing. Rows that repeat a doc_id share its component; a null id is a component of its own. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestext import ASCII_LOWER, mixed, slices, span_hashes, words
from .common import UPPER, LOWER, stash

ROWS, BANDS = 5, 34
SAMPLES = ROWS * BANDS
SKETCH_BITS, SET_BITS, MARGIN = 1024, 2048, 4.0
BLOCK = 512
#: Rows whose blocks are looked at together; salts that a set of many documents is dealt out by.
CHUNK_ROWS, SALTS = 1 << 13, 16

_rng = np.random.default_rng(4)
_TIMES = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_TOGGLE = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TO_LOWER = str.maketrans(UPPER, LOWER)


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts from their words' hashes, and the bounds of each text's."""
    n = np.diff(bounds)
    pieces = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out_bounds = np.concatenate([[0], np.cumsum(pieces)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], pieces) + np.arange(out_bounds[-1])
    last_of_text = np.repeat(bounds[1:], pieces)
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        inside = first + k < last_of_text
        step = np.where(inside, h[np.minimum(first + k, len(h) - 1)], np.uint64(0)) if len(h) else out
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(k + 1))
    return out, out_bounds


def text_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """First and end row and the sorted sets of shingle hashes of some rows at a time. A long text comes in pieces: each but the
    last hands its last words on, so that no shingle is lost where pieces meet."""
    tail, found = np.zeros(0, np.uint64), []
    for part in slices(texts, split=True):
        starts, ends, bounds = words(part)
        h = span_hashes(ASCII_LOWER[part.data], starts, ends)
        goes_on = part.first == part.last
        if goes_on or found or len(tail):
            h = np.concatenate([tail, h])
            if goes_on:
                if len(h) >= size:
                    found.append(np.unique(shingle_hashes(h, np.array([0, len(h)]), size)[0]))
                tail = h[max(0, len(h) - size + 1) :] if size > 1 else h[:0]
                continue
            if len(h) >= size or not found:
                found.append(np.unique(shingle_hashes(h, np.array([0, len(h)]), size)[0]))
            yield part.first, part.last, [np.unique(np.concatenate(found))]
            tail, found = np.zeros(0, np.uint64), []
            continue
        hashes, cuts = shingle_hashes(h, bounds, size)
        yield part.first, part.last, [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (16 bytes), bands, sketch (of the minima, then of the set), for each row of docs."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, end, sets in text_sets(batch.column("text"), size):
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
                at = np.cumsum(n[full]) - n[full]
                bands = np.zeros((len(n), BANDS), np.uint64)
                sketch = np.zeros((len(n), SKETCH_BITS), np.uint8)
                owner = np.repeat(np.arange(len(n)), n)
                bit = (flat >> np.uint64(20)).astype(np.int64) % SET_BITS
                whole = (np.bincount(owner * SET_BITS + bit, minlength=len(n) * SET_BITS) & 1).astype(np.uint8).reshape(-1, SET_BITS)
                set_hash = np.zeros((len(n), 2), np.uint64)
                if len(full):
                    set_hash[full, 0] = np.add.reduceat(flat, at)
                    set_hash[full, 1] = np.add.reduceat(mixed(flat + np.uint64(99)), at)
                    for i in range(SAMPLES):
                        least = np.minimum.reduceat(flat * _TIMES[i] + _PLUS[i], at)
                        least = mixed(least + _TOGGLE[i])
                        band = bands[full, i // ROWS]
                        bands[full, i // ROWS] = mixed(band * np.uint64(31) + least)
                        sketch[full, (least % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
                flat_bands = pa.array(bands.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin),
                        pa.array(n, pa.int64()),
                        pa.array([x.tobytes() for x in set_hash], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat_bands) + 1, BANDS), pa.int32()), flat_bands),
                        pa.array([x.tobytes() for x in np.packbits(np.hstack([sketch, whole]), axis=1)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_hash", "bands", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        signed, f"doc_id {kind}, n_shingles long, set_hash binary, bands array<long>, sketch binary"
    )


def sketch_limit(percent: int) -> int:
    """The most differing bits of two sketches that leave the similarity percent / 100 possible, at MARGIN deviations.

    d minima that differ toggle 2 d bits, of which (1 - exp(-4 d / SKETCH_BITS)) / 2 of the bitmap are left set.
    """
    s = percent / 100
    differ = min(SAMPLES, SAMPLES * (1 - s) + MARGIN * np.sqrt(SAMPLES * s * (1 - s)))
    left = SKETCH_BITS / 2 * (1 - np.exp(-4 * differ / SKETCH_BITS))
    return int(left + MARGIN * np.sqrt(left / 2))


WORDS = (SKETCH_BITS + SET_BITS) // 64


def _bits(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, WORDS) if len(column) else np.zeros((0, WORDS), np.uint64)


def sketches_near(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches leave the similarity possible; nx, ny: sizes of the sets.

    Sets of sizes a and b with similarity s differ in (a + b) * (1 - s) / (1 + s) shingles at most.
    """
    ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    odd = np.bitwise_count(x ^ y)
    cut = SKETCH_BITS // 64
    ok &= odd[:, :cut].sum(axis=1) <= sketch_limit(percent)
    differ = (nx + ny) * (100 - percent) / (100 + percent)
    left = SET_BITS / 2 * (1 - np.exp(-2 * differ / SET_BITS))
    return ok & (odd[:, cut:].sum(axis=1) <= left + MARGIN * np.sqrt(left / 2 + 1))


def near_by_sketch(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sketches are near."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        return pd.Series(sketches_near(_bits(x), _bits(y), nx.to_numpy(), ny.to_numpy(), percent))

    left = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n_shingles").alias("n_a"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n_shingles").alias("n_b"))
    return pairs.join(left, "a").join(right, "b").where(near("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * shared >= percent * union of their full shingle sets."""

    def shingles(text: str | None) -> frozenset:
        w = _WORD.findall((text or "").translate(_TO_LOWER))
        return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out, last, mine = [], None, frozenset()
        for a, b in zip(x, y, strict=True):
            if a is not last and a != last:
                last, mine = a, shingles(a)
            other = shingles(b)
            shared = len(mine & other)
            out.append(shared > 0 and 100 * shared >= percent * (len(mine) + len(other) - shared))
        return pd.Series(out, dtype=bool)

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").where(linked("text_a", "text_b")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """doc_id and component (the smallest doc_id reachable) of every document with a link.

    Each round links every document and its neighbours to the smallest of them, first for larger neighbours, then for
    smaller ones, until nothing changes; the number of rounds grows with the logarithm of a component's size. Both halves
    are joins with a partial aggregate, so a document with very many neighbours is no task's own.
    """
    edges = stash(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above a document link to the smallest document that it knows
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.join(least, edges["lo"] == least["u"]).select(F.col("m").alias("lo"), "hi").distinct()
        # small star: a document and its smaller neighbours link to the smallest of these
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi")))).alias("e")).select("e.*")
        edges = stash(small.where("lo < hi").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("doc_id"), "component")
        before = now


def leader_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's leaders with its members: the smallest id, and the document whose buckets are fullest,
    which in a group of copies with different changes is nearest to what they were made from."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    central = buckets.join(sizes.select("bucket", "n"), "bucket").groupBy("doc_id").agg(F.sum("n").alias("score"))
    best = F.max_by("doc_id", F.struct("score", -F.col("doc_id")))
    heads = buckets.join(central, "doc_id").groupBy("bucket").agg(best.alias("central")).join(sizes.select("bucket", "first"), "bucket")
    met = buckets.join(heads, "bucket").select(F.explode(F.array_distinct(F.array("first", "central"))).alias("leader"), "doc_id").where("leader <> doc_id")
    return met.select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """doc_id and shingles: the sorted 64-bit hashes of each text's set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for begin, end, sets in text_sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, shingles binary")


def in_doubt(dealt: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The rows of dealt, whose blocks are (bucket, low, high), that hold a pair of different components whose sizes and
    sketches leave a link possible, in the first band that the pair shares. Blocks are worked on many at a time."""
    chunks = max(1, math.ceil(dealt.count() / CHUNK_ROWS))
    rows = dealt.join(reps, "doc_id").withColumn("chunk", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(chunks)))

    def doubtful(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "low", "high", "doc_id"], ignore_index=True)
        bits, bands = _bits(rows["sketch"]), np.vstack(rows["bands"].to_numpy())
        n, own, band = (rows[c].to_numpy() for c in ("n_shingles", "own", "band"))
        block = rows.groupby(["bucket", "low", "high"], sort=False).ngroup().to_numpy()
        inner = (rows["low"] == rows["high"]).to_numpy()
        group = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        found = np.zeros(len(rows), bool)
        i, step = np.arange(len(rows)), 0
        while len(i):  # all pairs of a block, by their distance in the sorted rows
            step += 1
            i = i[i + step < len(rows)]
            i = i[block[i] == block[i + step]]
            j = i + step
            new = (group[i] != group[j]) & (inner[i] | (own[i] != own[j]))
            new &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            a, b = i[new], j[new]
            if len(a):
                new = (bands[a] == bands[b]).argmax(axis=1) == band[a]
                a, b = a[new], b[new]
                new = sketches_near(bits[a], bits[b], n[a], n[b], percent)
                found[a[new]] = found[b[new]] = True
        return rows.loc[found, ["bucket", "band", "doc_id", "component", "own", "low", "high"]]

    return rows.groupBy("chunk").applyInPandas(doubtful, dealt.select("bucket", "band", "doc_id", "component", "own", "low", "high").schema)


def remaining_links(buckets: DataFrame, found: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links (a, b) that connect members of one bucket in different components, block by block; None if there can't be any."""
    members = buckets.join(found, "doc_id", "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"))
    split = split.where("parts > 1").select(
        "bucket",
        F.col("most.component").alias("main"),
        F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.col("most.n") / BLOCK).cast("int").alias("outer_blocks"),
    )
    split = stash(split, "split")
    if split.isEmpty():
        return None
    member = members.join(split, "bucket")
    outer = F.col("component") == F.col("main")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n).cast("long")).cast("int")
    # blocks of the main component have numbers below 0 and meet all other blocks, but not each other
    met = F.sequence(F.when(outer, F.lit(0)).otherwise(-F.col("outer_blocks")), F.col("blocks") - 1)
    member = member.withColumn("own", F.when(outer, -1 - block("outer_blocks")).otherwise(block("blocks")))
    dealt = member.select("bucket", "band", "doc_id", "component", "own", F.explode(met).alias("other"))
    dealt = dealt.select("bucket", "band", "doc_id", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    dealt = stash(in_doubt(stash(dealt, "dealt"), reps, percent), "doubt")
    if dealt.isEmpty():
        return None
    wanted = texts.join(dealt.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    sets = shingle_sets(wanted, size).dropDuplicates(["doc_id"])
    rows = dealt.join(reps.join(sets, "doc_id"), "doc_id")

    def compared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        rows = rows.sort_values("doc_id")
        bits, n, own, ids = _bits(rows["sketch"]), rows["n_shingles"].to_numpy(), rows["own"].to_numpy(), rows["doc_id"].to_numpy()
        bands, band = np.vstack(rows["bands"].to_numpy()), rows["band"].iloc[0]
        sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
        group = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        left, right, links = np.flatnonzero(own == high), np.flatnonzero(own == low), []
        for i in left:
            others = right[right > i] if low == high else right
            others = others[group[others] != group[i]]
            others = others[(bands[others] == bands[i]).argmax(axis=1) == band]
            for j in others[sketches_near(bits[others], bits[i], n[others], n[i], percent)]:
                if group[j] != group[i]:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                        links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                        group[group == group[j]] = group[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    found = stash(rows.groupBy("bucket", "low", "high").applyInPandas(compared, "a long, b long").distinct(), "rest")
    return confirmed(found, texts, size, percent)  # hashes told these; words confirm them


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of docs."""
    texts = docs.select("doc_id", "text")
    signed = stash(signatures(texts, size), "signed")
    full = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    alike = full.groupBy("set_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = full.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    classes = salted.join(alike.select("set_hash", "first_id", salts), ["set_hash", "salt"], "left")
    classes = stash(classes.select("doc_id", "n_shingles", "bands", "sketch", F.coalesce("first_id", "doc_id").alias("first_id")), "classes")
    same = classes.where("doc_id <> first_id").select(F.col("first_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    same = stash(confirmed(same, texts, size, percent), "same")
    reps = classes.where("doc_id = first_id").drop("first_id").dropDuplicates(["doc_id"])
    reps = stash(reps, "representatives")
    buckets = reps.select("doc_id", F.posexplode("bands").alias("band", "hash")).select("doc_id", "band", F.xxhash64("band", "hash").alias("bucket"))
    crowded = buckets.groupBy("bucket").count().where("count > 1").select("bucket")
    buckets = stash(buckets.join(crowded, "bucket", "left_semi"), "buckets")
    pairs = stash(near_by_sketch(leader_pairs(buckets), reps, percent), "pairs")
    links = stash(confirmed(pairs, texts, size, percent), "links")
    rest = remaining_links(buckets, components(links), reps, texts, size, percent)
    if rest is not None:
        links = links.union(stash(rest, "rest"))
    found = components(links.union(same))
    component = F.coalesce("component", "doc_id")
    return signed.join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def keep_one_of_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that are near duplicates of a smaller doc_id."""
    gone = near_groups(docs, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__id"))
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
