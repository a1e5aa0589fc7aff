"""Order-preserving packing of documents into token windows by dynamic programming.

Documents are taken in the order in which the table holds them and their tokens form one stream per input partition. A cut
may stand where a document ends, for nothing; where a sentence or line ends, for SENTENCE_CUT; and, in stretches without
either, at every STRIDE-th token, for TOKEN_CUT. The cuts that minimise padding plus penalties, no window over the limit,
follow from

    f(j) = penalty(j) + window - p(j) + min over i with p(j) - p(i) <= window of f(i) + p(i)

whose minimum over a sliding range a monotone queue yields in constant time. The stream is cut in segments of SEGMENT
tokens; all but the last SETTLE windows of a segment are final, their tokens go on to the next segment, so memory is bounded
and nothing is lost where segments meet. Nothing is shuffled, and a window's id is its partition and its number in it, so
a task that runs again returns the same rows.

Defined cases: a null or empty text has no ids but the end id. A document longer than a window is cut. Rows that repeat a
document are packed as often. Null ids stay null. An empty table gives an empty result. Other columns are ignored. The last
window of a partition holds what is left.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .subwords import subwords

WINDOW, END_ID = 2048, 1
SENTENCE_CUT, TOKEN_CUT, STRIDE = 4.0, 64.0, 128
SEGMENT, SETTLE = 1 << 20, 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The cheapest cuts among places, which rise from 0 by at most `window`; the first and last place are among them."""
    p, cost = places.tolist(), penalties.tolist()
    f, back = [0.0] * len(p), [0] * len(p)
    queue, keys = deque([0]), [0.0] * len(p)
    for j in range(1, len(p)):
        here = p[j]
        while here - p[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        f[j] = cost[j] + window - here + keys[i]
        keys[j] = key = f[j] + here
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [len(p) - 1], len(p) - 1
    while j:
        j = back[j]
        cuts.append(j)
    return places[np.array(cuts[::-1])]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, and what a cut costs there."""
    n = len(ids)
    kind = np.zeros(n + 1, np.int8)
    kind[1:][sentence_ends[ids]] = 2
    kind[doc_ends] = 3
    kind[[0, n]] = 3
    places = np.flatnonzero(kind)
    gaps = np.diff(places)
    for at in np.flatnonzero(gaps > STRIDE):
        kind[np.arange(places[at] + STRIDE, places[at + 1], STRIDE)] = 1
    places = np.flatnonzero(kind)
    return places, np.array([0.0, TOKEN_CUT, SENTENCE_CUT, 0.0])[kind[places]]


class _Stream:
    """The tokens that have no final window yet, and the documents that they belong to."""

    def __init__(self, part: int, ends: np.ndarray, window: int):
        self.ids = np.zeros(0, np.uint16)
        self.doc_starts = np.zeros(0, np.int64)  # below 0 if the document's first tokens are gone
        self.doc_ids: list[int | None] = []
        self.doc_tokens = np.zeros(0, np.int64)
        self.next_window, self.sentence_ends, self.window = part << 33, ends, window

    def add(self, ids: np.ndarray, bounds: np.ndarray, doc_ids: list[int | None]) -> None:
        lengths = np.diff(bounds)
        grown = np.full(len(ids) + len(lengths), END_ID, np.uint16)
        keep = np.ones(len(grown), bool)
        keep[np.cumsum(lengths + 1) - 1] = False
        grown[keep] = ids
        self.doc_starts = np.concatenate([self.doc_starts, len(self.ids) + bounds[:-1] - bounds[0] + np.arange(len(lengths))])
        self.doc_tokens = np.concatenate([self.doc_tokens, lengths + 1])
        self.doc_ids += doc_ids
        self.ids = np.concatenate([self.ids, grown])

    def pieces(self, last: bool) -> pa.RecordBatch | None:
        if not len(self.ids):
            return None
        ends = self.doc_starts + self.doc_tokens
        cuts = best_cuts(*cut_places(self.ids, ends, self.sentence_ends), self.window)
        if not last:
            cuts = cuts[: max(1, len(cuts) - SETTLE)]
        n = int(cuts[-1])
        if not n:
            return None
        borders = np.union1d(cuts, ends[ends < n])
        begins, lengths = borders[:-1], np.diff(borders)
        doc, window = np.searchsorted(ends, begins, side="right"), np.searchsorted(cuts, begins, side="right") - 1
        raw = memoryview(self.ids[:n].astype("<u4").tobytes())
        checks = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begins.tolist(), lengths.tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.doc_ids[d] for d in doc.tolist()], pa.int64()),
                pa.array(begins - self.doc_starts[doc], pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(checks, pa.int64()),
                pa.array(self.doc_tokens[doc], pa.int64()),
                pa.array(self.next_window + window, pa.int64()),
                pa.array(begins - cuts[window], pa.int64()),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )
        self.next_window += len(cuts) - 1
        done = int(np.searchsorted(ends, n, side="right"))
        self.ids, self.doc_starts = self.ids[n:], self.doc_starts[done:] - n
        self.doc_ids, self.doc_tokens = self.doc_ids[done:], self.doc_tokens[done:]
        return out


def pack(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords(ranks_path)
        stream = _Stream(TaskContext.get().partitionId(), encoder.ends, window)
        for batch in batches:
            for first, last, ids, bounds in encoder.encode(batch.column("text")):
                stream.add(ids, bounds, batch.column("doc_id").slice(first, last - first).to_pylist())
                if len(stream.ids) >= SEGMENT and (out := stream.pieces(last=False)) is not None:
                    yield out
        if (out := stream.pieces(last=True)) is not None:
            yield out

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(packed, SCHEMA)
