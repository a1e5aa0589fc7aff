"""A quality classifier over document statistics.

Every whole text becomes a vector of statistics (lengths, kinds of characters, repetition). Random Fourier features
approximate a Gaussian kernel over the standardised statistics. Each partition of labelled rows sums its own normal
equations; the sums meet as a tree of block sums, not in one task, and the ridge weights are solved for on the driver, which
gets one matrix of fixed size. Isotonic regression on labelled rows that the ridge fit hasn't seen turns raw scores into
probabilities; it needs label sums per 1/BINS of the raw score, a number of rows that is fixed too.

All labelled rows outside the held-out share are used, four fifths for the ridge fit and one fifth to calibrate.

Defined cases: null and empty texts get a score from their statistics like others. Labels other than 0 and 1, and labels of
unknown documents, are left out. Without labelled rows every score is 0.5, with one kind of label it is that label's. Rows
that repeat a document are scored alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestext import ASCII_LOWER, WHITE, Slice, group_sums, per_text, slices, span_hashes, words
from .common import BLOCKS, block_sums, blocks_of, remainder, stash

FEATURES, RIDGE, BINS, SEED = 192, 1e-3, 400, 7
MODULUS, HELD_OUT, CALIBRATE = 4, 2, 5

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|<>{}[]\\/=_",
    "symbol": b"$%&#*@^~+",
    "line": b"\n",
    "white": bytes(np.flatnonzero(WHITE).tolist()),
    "high": bytes(range(128, 256)),
}
STATISTICS = 23


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_FLAGS = {name: _flags(members) for name, members in _CLASS.items()}


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct hashes, and how often the most frequent one is there."""
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, t[at], runs)
    return np.bincount(t[at], minlength=n), most


def statistics(part: Slice) -> np.ndarray:
    """A row of STATISTICS numbers for each text of the slice."""
    data = part.data
    size = (part.ends - part.starts).astype(float)
    count = {name: per_text(flags[data], part).astype(float) for name, flags in _FLAGS.items()}
    low = ASCII_LOWER[data]
    starts, ends, bounds = words(part)
    n_words = np.diff(bounds).astype(float)
    some, some_words = np.maximum(size, 1), np.maximum(n_words, 1)
    letters = np.maximum(count["upper"] + count["lower"] + count["high"] / 2, 1)
    lengths = (ends - starts).astype(float)
    mean = group_sums(lengths, bounds) / some_words
    spread = np.sqrt(np.maximum(group_sums(lengths**2, bounds) / some_words - mean**2, 0))
    hashes = span_hashes(low, starts, ends)
    distinct, most = _distinct(hashes, bounds)
    pairs = np.append(hashes[:-1] * np.uint64(3) + hashes[1:], np.uint64(0))[: len(hashes)]
    pair_kinds, _ = _distinct(pairs, bounds)
    breaks = _FLAGS["line"][data]
    opens = np.zeros(len(data), bool)
    opens[part.starts[part.ends > part.starts]] = True
    opens[1:] |= breaks[:-1]
    line_starts = np.flatnonzero(opens)
    line_bounds = np.searchsorted(line_starts, np.append(part.starts, len(data)))
    line_kinds, line_most = _distinct(span_hashes(low, line_starts, np.append(line_starts[1:], len(data))[: len(line_starts)]), line_bounds)
    lines = np.maximum(np.diff(line_bounds), 1)
    tail = ends - 1
    marked = (_FLAGS["symbol"] | _FLAGS["shout"])[data[tail]] if len(tail) else np.zeros(0, bool)
    short, long = lengths <= 3, lengths > 20
    ratio = lambda name: count[name] / some
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            mean,
            spread,
            count["upper"] / letters,
            ratio("digit"),
            ratio("stop"),
            np.sqrt(ratio("shout")),
            np.sqrt(ratio("bar")),
            np.sqrt(ratio("symbol")),
            np.sqrt(ratio("line")),
            ratio("white"),
            np.sqrt(ratio("high")),
            letters / some,
            distinct / some_words,
            most / some_words,
            pair_kinds / some_words,
            line_kinds / lines,
            line_most / lines,
            group_sums(marked.astype(float), bounds) / some_words,
            group_sums(short.astype(float), bounds) / some_words,
            np.sqrt(group_sums(long.astype(float), bounds) / some_words),
            np.log1p(some_words / lines),
        ]
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the vector of statistics, for each row."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part in slices(batch.column("text")):
                x = np.ascontiguousarray(statistics(part))
                flat = pa.array(x.ravel(), pa.float64())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, STATISTICS), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, part.last - part.first), rows], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Model:
    """Weights of the ridge fit and steps of the calibration; a few hundred numbers each."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray):
        self.centre, self.scale = centre, scale
        rng = np.random.default_rng(SEED)
        width = np.sqrt(len(centre))  # of the kernel: the usual distance of two standardised vectors is sqrt(2) times that
        self.turn = rng.normal(size=(len(centre), FEATURES)) / width
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + len(centre) + 1)
        self.steps, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.turn + self.phase), z / 10, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # the raw score breaks ties within a step, by a hundredth at most
        return np.clip(0.99 * np.interp(raw, self.steps, self.levels) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def isotonic(at: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: the rising steps nearest to sums / counts; each step's mean place and level."""
    blocks: list[list[float]] = []
    for x, s, n in zip(at, sums, counts, strict=True):
        blocks.append([x * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.25) / (b[:, 2] + 0.5)


def _stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, STATISTICS))


def fit(labelled: DataFrame) -> Model:
    """labelled: x, y (0 or 1) and fold (0 to CALIBRATE - 1; fold 0 calibrates)."""
    spark = labelled.sparkSession
    item = [F.element_at("x", i + 1) for i in range(STATISTICS)]
    head = labelled.agg(
        F.count(F.lit(1)), F.sum("y"), *[F.avg(c) for c in item], *[F.stddev_pop(c) for c in item]
    ).first()
    n, ones = head[0], head[1] or 0
    if not n:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    centre, scale = np.array(head[2 : 2 + STATISTICS], float), np.array(head[2 + STATISTICS :], float)
    model = Model(centre, np.where(scale > 1e-9, scale, 1.0))
    if ones in (0, n):
        model.levels = np.array([float(ones > 0)])
        return model
    width = len(model.weights)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((width, width + 1)), 0
        for batch in batches:
            phi = model.features(_stack(batch.column("x").to_pandas()))
            total += phi.T @ np.column_stack([phi, batch.column("y").to_numpy(zero_copy_only=False).astype(float)])
            rows += batch.num_rows
        if rows:
            yield blocks_of(total, rows, TaskContext.get().partitionId())

    sums = block_sums(labelled.where("fold > 0").select("x", "y").mapInArrow(summed, BLOCKS))
    table = sums[1].reshape(width, width + 1) if sums else np.zeros((width, width + 1))  # a matrix of fixed size
    gram, right = table[:, :-1], table[:, -1]
    rows = max(gram[-1, -1], 1.0)
    penalty = np.full(width, RIDGE * rows)
    penalty[-1] = 1e-6
    model.weights = np.linalg.solve(gram + np.diag(penalty), right)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bin": np.round(model.raw(_stack(batch["x"])) * BINS).astype(int), "y": batch["y"]})

    bins = labelled.where("fold = 0").select("x", "y").mapInPandas(scored, "bin long, y long")
    bins = bins.groupBy("bin").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # 2 * BINS rows at most
    if bins:
        model.steps, model.levels = isotonic(*(np.array([r[c] for r in bins], float) / k for c, k in (("bin", BINS), ("s", 1), ("n", 1))))
    else:
        model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score for each row of docs."""
    measured = stash(document_statistics(docs), "statistics")
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("long").alias("y"))
    rest = remainder(F.col("doc_id"), MODULUS)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE))
    train = measured.where(rest != HELD_OUT).join(known.where(rest != HELD_OUT), "doc_id").select("x", "y", fold.alias("fold"))
    model = fit(stash(train, "train"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(_stack(x)))

    return measured.select("doc_id", (rest == HELD_OUT).alias("held_out"), score("x").alias("score"))
