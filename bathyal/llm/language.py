"""Language identification by rank-order profiles of character n-grams.

A text's letters are lower-cased, every run of other characters becomes one gap, and n-grams of one to three such signs are
counted. A language's profile is its PROFILE most frequent n-grams over all training texts; a document's own most frequent
n-grams are compared to each profile by out-of-place distance: the sum of rank differences, PROFILE for n-grams that the
profile lacks. The nearest language wins, the first by name among equals.

n-grams are counted per language within each partition before counts are shuffled, so no language is too large for a task.
Profiles are what is sent to all tasks: PROFILE rows per language.

Defined cases: a null text, and one without a letter, gets `und` with score 0, as has every text when there is nothing to
learn from. Training rows without a language are left out. Equal counts rank by n-gram. Rows that repeat a document are
classified alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import remainder

PROFILE, MODULUS, HELD_OUT, UNKNOWN = 300, 3, 1, "und"
#: Texts whose score is lower are in no language that was learnt.
REJECT = 0.2
#: A dense table counts n-grams if it has at most DENSE cells for each sign; else they are sorted.
DENSE, SLICE_CHARS = 16, 1 << 19
BITS = 21
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        _letters.append(table)
    return _letters[0]


def signs(text: str) -> np.ndarray:
    """Code points of the letters; 0 for each gap, one in front and one behind."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_is_letter()[points], points, 0).astype(np.int64)
    points = np.concatenate([[0], points, [0]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep]


def _codes(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """One number per n-gram from the code points of its signs, a row each. A pair's has bit 62, which no triple sets."""
    return np.concatenate([one, ((two[0] << BITS) | two[1]) + (1 << 62), (((three[0] << BITS) | three[1]) << BITS) | three[2]])


def counted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three signs and their counts; those with two gaps in a row, as where texts meet, are left out."""
    gap = s == 0
    pair = ~(gap[:-1] & gap[1:])
    triple = pair[:-1] & pair[1:]
    alphabet = np.flatnonzero(np.bincount(s))
    k = len(alphabet)
    if k**3 > DENSE * len(s) + 50_000:
        two, three = np.stack([s[:-1], s[1:]])[:, pair], np.stack([s[:-2], s[1:-1], s[2:]])[:, triple]
        return np.unique(_codes(s[~gap], two, three), return_counts=True)
    place = np.zeros(alphabet[-1] + 1, np.int64)
    place[alphabet] = np.arange(k)
    c = place[s]
    one = np.bincount(c[~gap], minlength=k)
    two = np.bincount((c[:-1] * k + c[1:])[pair], minlength=k * k)
    three = np.bincount(((c[:-2] * k + c[1:-1]) * k + c[2:])[triple], minlength=k**3)
    i, j, m = np.flatnonzero(one), np.flatnonzero(two), np.flatnonzero(three)
    pairs, triples = alphabet[np.stack([j // k, j % k])], alphabet[np.stack([m // (k * k), m // k % k, m % k])]
    return _codes(alphabet[i], pairs, triples), np.concatenate([one[i], two[j], three[m]])


def top(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order, ties by code."""
    if len(codes) > 2 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


class Profiles:
    def __init__(self, names: list[str], ranked: list[np.ndarray]):
        self.names = names
        self.sorted = [(p[o := np.argsort(p)], o) for p in ranked]

    def nearest(self, mine: np.ndarray) -> tuple[str, float]:
        ranks = np.arange(len(mine))
        distances = []
        for codes, order in self.sorted:
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            out_of_place = np.where(codes[at] == mine, np.abs(order[at] - ranks), PROFILE)
            distances.append(int(out_of_place.sum()))
        best = int(np.argmin(distances))
        return self.names[best], 1 - distances[best] / (PROFILE * max(len(mine), 1))


def ngram_counts(texts: DataFrame) -> DataFrame:
    """lang, code, n over all rows of texts, which has lang and text."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def fold(lang: str) -> None:
            parts = held.setdefault(lang, [])
            if waiting.get(lang):
                parts.append(counted(np.concatenate(waiting.pop(lang))))
                size[lang] = 0
            if len(parts) > 1:
                codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                held[lang] = [(codes, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64))]

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = signs(text)
                waiting.setdefault(lang, []).append(s)
                size[lang] = size.get(lang, 0) + len(s)
                if size[lang] > SLICE_CHARS:
                    fold(lang)
        for lang in sorted(set(held) | set(waiting)):
            fold(lang)
            codes, n = held.pop(lang)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    return texts.select("lang", "text").mapInArrow(partial, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def profiles(texts: DataFrame) -> Profiles:
    """Of all languages in texts: PROFILE rows for each come to the driver."""
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    rows = ngram_counts(texts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).drop("n").collect()
    by: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return Profiles(sorted(by), [np.array([c for _, c in sorted(by[k])], np.int64) for k in sorted(by)])


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with two columns more, __lang and __score; training has lang and text."""
    known = training.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    model = profiles(known)

    def nearest(text: str | None) -> tuple[str, float]:
        s = signs(text or "")
        return model.nearest(top(*counted(s))) if model.names and s.any() else (UNKNOWN, 0.0)

    def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(t) for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__lang", "__score"])

    return docs.mapInArrow(classified, StructType([*docs.schema.fields, StructField("__lang", StringType()), StructField("__score", DoubleType())]))


def held_out(doc_id):
    return remainder(doc_id, MODULUS) == HELD_OUT


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learning from documents that aren't held out."""
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_known_language(docs: DataFrame, least: float = REJECT) -> DataFrame:
    """docs without the rows that language ID rejects: those without a letter, and those whose n-grams are so far out of place
    in the nearest profile, with a score under `least`, that they are no text in any language that was learnt."""
    found = identify(docs, docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).drop("__lang", "__score")
