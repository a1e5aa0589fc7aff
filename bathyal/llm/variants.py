"""Grouping of spelling variants by a trie self-join with active-node sets.

Words are counted by hashes of flat bytes in each task, then summed. Near words are found in tries: a node's active nodes are
those within distance one of it; a child's active nodes follow from its parent's, and two words whose ends are active for each
other are a pair. One edit leaves either the first h or the last h characters of both words as they are (h is half the least
length), so the vocabulary is dealt out twice, by its first and by its last h characters, and each part is a trie of what lies
between. An edit counts at its first possible place: the parts by first characters take places from h on, those by last
characters the places before, so each pair is found once and nothing is active across parts. A part of more than PART_WORDS
words is dealt out again in the same way, with h half of its own least length (1 at least), until each part fits. Parts meet in groups of about that size,
whose tries are walked together, level by level, in numpy.

The set of a node is kept one-sided: itself, nodes of its depth whose differing character is larger, and nodes one shorter.

Defined cases: a null text has no words. A null id counts as empty text in the checksum. Words repeated in `near_pairs` count
once if their rows are alike. An empty table gives an empty result. Other columns are ignored. Long words are whole words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestext import ASCII_LOWER, Slice, group_sums, slices, span_hashes
from .common import lookup, stash

SLICE_BYTES = 2 << 20
PART_WORDS = 1 << 15
#: Bytes of a run that are taken into the checksum of all runs together.
TOGETHER = 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3  # of the two bytes of U+00C0 to U+00FF


def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


_CRC = _table()


def runs(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, number of code points and text (from 0) of each run of letters."""
    lead = part.data == _LEAD
    letter = _LETTER[part.data] | lead
    letter[1:] |= lead[:-1]
    opens, closes = letter.copy(), letter.copy()
    opens[1:] &= ~letter[:-1]
    closes[:-1] &= ~letter[1:]
    inner = part.starts[(part.starts < len(letter)) & (part.ends > part.starts)]
    opens[inner] = letter[inner]
    closes[inner[1:] - 1] = letter[inner[1:] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    points = ends - starts - group_sums(lead, np.stack([starts, ends], 1).ravel())[::2].astype(np.int64) if len(starts) else starts
    return starts, ends, points, np.searchsorted(part.starts, starts, side="right") - 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, going on from the checksum of what stands before it."""
    order = np.argsort(starts - ends, kind="stable")
    at, lengths = starts[order], (ends - starts)[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    longer = np.searchsorted(-lengths, -np.arange(min(int(lengths[0]), TOGETHER) if len(lengths) else 0), side="left")
    for j, k in enumerate(longer.tolist()):
        state[:k] = _CRC[(state[:k] ^ data[at[:k] + j]) & np.uint32(0xFF)] ^ (state[:k] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-lengths, -TOGETHER, side="left"))):
        state[k] = zlib.crc32(data[at[k] + TOGETHER : at[k] + lengths[k]].tobytes(), int(state[k]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an array of strings."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    held = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(held)).cast(pa.string())


def counted(part: Slice, ids: list, every: int, least_chars: int) -> Iterator[pa.RecordBatch]:
    starts, ends, points, text = runs(part)
    long = points >= least_chars
    starts, ends, points, text = starts[long], ends[long], points[long], text[long]
    if not len(starts):
        return
    data = ASCII_LOWER[part.data]
    before = np.array([zlib.crc32(b":" if i is None else f"{i}:".encode()) for i in ids], np.uint32)
    sums = checksums(data, starts, ends, before[text])
    slip = sums % np.uint32(every) == 0
    clean = np.flatnonzero(~slip)
    _, first, n = np.unique(span_hashes(data, starts[clean], ends[clean]), return_index=True, return_counts=True)
    kept = clean[first]
    yield pa.RecordBatch.from_arrays([_taken(data, starts[kept], ends[kept]), pa.array(n, pa.int64())], names=["word", "n"])
    slipped = []
    for k in np.flatnonzero(slip & (points > least_chars)).tolist():
        run, gone = data[starts[k] : ends[k]].tobytes().decode(), int(sums[k]) % int(points[k])
        slipped.append(run[:gone] + run[gone + 1 :])
    yield pa.RecordBatch.from_arrays([pa.array(slipped, pa.string()), pa.array(np.ones(len(slipped)), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, every: int = 199, least_chars: int = 6) -> DataFrame:
    """word and n: the runs of letters, A-Z in lower case, of at least `least_chars` code points. A run whose checksum with its
    document's id is a multiple of `every` loses one code point first, as a slip of the pen would."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for part in slices(batch.column("text"), SLICE_BYTES, split=True):
                yield from counted(part, ids[part.first : max(part.last, part.first + 1)], every, least_chars)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class _Edges:
    """The edges from nodes 0 to n - 1 of a level to those of the next: parents and characters, both ascending."""

    def __init__(self, parents: np.ndarray, chars: np.ndarray, n: int):
        self.parents, self.chars, self.keys = parents, chars, parents << 21 | chars
        self.first = np.searchsorted(parents, np.arange(n + 1))

    def stepped(self, u: np.ndarray, v: np.ndarray, of_v: _Edges) -> tuple[np.ndarray, np.ndarray]:
        """Children of u and of v by a character that both have."""
        n = self.first[u + 1] - self.first[u]
        child = np.repeat(self.first[u], n) + _ramp(n)
        keys = np.repeat(v, n) << 21 | self.chars[child]
        place = np.minimum(np.searchsorted(of_v.keys, keys), max(len(of_v.keys) - 1, 0))
        same = of_v.keys[place] == keys if len(of_v.keys) else np.zeros(len(keys), bool)
        return child[same], place[same]


def trie_pairs(part: np.ndarray, words: list[str], last: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of words of one part at distance one whose edit begins before the part's limit.

    part: the part of each word, ascending; words: ascending within the part, none twice. last: the character before the words
    of each part, or -1: a character that equals the one before it isn't where a run loses one. limit: by part.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    offsets = np.cumsum(lengths) - lengths
    none = np.zeros(0, np.int64)
    same, shorter = (none, none), (none, none)  # active nodes of the same depth and one less deep
    found: list[tuple[np.ndarray, np.ndarray]] = []
    alive, node, unit, tail = np.arange(len(words)), part.astype(np.int64), np.arange(len(last)), last.astype(np.int64)
    ended_before, edges_before = none, None
    for depth in range(int(lengths.max(initial=0)) + 1):
        ended = np.full(len(unit), -1)
        over = lengths[alive] == depth
        ended[node[over]] = alive[over]
        for (u, v), ends in ((same, ended), (shorter, ended_before)):
            if len(u):
                both = (ended[u] >= 0) & (ends[v] >= 0)
                found.append((ended[u[both]], ends[v[both]]))
        crowded = np.bincount(node, minlength=len(unit)) > 1
        alive, node = alive[~over], node[~over]
        if not len(alive) or not (len(same[0]) or len(shorter[0]) or (crowded & (depth < limit[unit])).any()):
            break
        char = codes[offsets[alive] + depth]
        new = np.ones(len(alive), bool)
        new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
        edges = _Edges(node[new], char[new], len(unit))
        child = np.arange(len(edges.parents))
        fertile = (crowded & (depth < limit[unit]))[edges.parents]
        one, n = child[fertile], (edges.first[edges.parents + 1] - child - 1)[fertile]
        siblings = np.repeat(one, n), np.repeat(one, n) + 1 + _ramp(n)
        lost = child[fertile & (edges.chars != tail[edges.parents])]
        went = edges.stepped(*same, edges)
        behind = edges.stepped(*shorter, edges_before) if edges_before is not None else (none, none)
        same = np.concatenate([siblings[0], went[0]]), np.concatenate([siblings[1], went[1]])
        shorter = np.concatenate([lost, behind[0]]), np.concatenate([edges.parents[lost], behind[1]])
        ended_before, edges_before = ended, edges
        node, unit, tail = np.cumsum(new) - 1, unit[edges.parents], edges.chars
    return tuple(np.concatenate(side) if found else none for side in (zip(*found, strict=True) if found else ((), ())))  # type: ignore[return-value]


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of all parts among the rows."""
    rows = rows.drop_duplicates(["head", "tail", "limit", "middle"]).sort_values(["head", "tail", "limit", "middle"], ignore_index=True)
    new = (rows[["head", "tail", "limit"]] != rows[["head", "tail", "limit"]].shift()).any(axis=1).to_numpy()
    last = np.array([ord(h[-1]) if h else -1 for h in rows["head"][new]], np.int64)
    a, b = trie_pairs(np.cumsum(new) - 1, list(rows["middle"]), last, rows["limit"][new].to_numpy())
    word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
    return pd.DataFrame({"a": word[a], "a_n": n[a], "b": word[b], "b_n": n[b]})


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row by the first and by the last h characters of its middle; rows with no more than one stay as they are."""
    m, size, h = F.col("middle"), F.length("middle"), F.col("h")
    part = lambda head, tail, limit, middle: F.struct(head.alias("head"), tail.alias("tail"), limit.cast("int").alias("limit"), middle.alias("middle"))
    head, tail, limit = F.col("head"), F.col("tail"), F.col("limit")
    ahead = F.when((size >= h) & (limit > h), part(F.concat(head, F.left(m, h)), tail, limit - h, F.substr(m, h + 1)))
    behind = F.when(size >= h, part(head, F.concat(F.right(m, h), tail), F.least(limit, h), F.left(m, size - h)))
    rest = F.when(size <= 1, part(head, tail, limit, m))
    each = rows.select("word", "n", F.explode(F.filter(F.array(ahead, behind, rest), lambda p: p.isNotNull())).alias("p"))
    return each.select("word", "n", "p.*")


def near_pairs(words: DataFrame, least_chars: int, part_words: int | None = None) -> DataFrame:
    """a, a_n, b, b_n: each pair of different words that differ by one inserted, deleted or replaced code point, once.

    words: word and n, none null; least_chars: no word is shorter, 1 at least.
    """
    part_words = part_words or PART_WORDS
    whole = words.select("word", "n", F.lit("").alias("head"), F.lit("").alias("tail"), F.lit(2**31 - 1).alias("limit"), F.col("word").alias("middle"))
    key = ["head", "tail", "limit"]
    ready, rows = [], whole.withColumn("h", F.lit(max(1, least_chars // 2)))
    while True:
        rows = stash(_dealt(rows), "parts")
        sizes = rows.groupBy(*key).agg(F.count_if(F.length("middle") > 1).alias("k"), F.min(F.length("middle")).alias("least"))
        full = stash(sizes.where(F.col("k") > part_words).select(*key, F.greatest(F.lit(1), F.expr("least div 2")).cast("int").alias("h")), "full")
        if full.isEmpty():
            ready.append(rows)
            break
        told = lookup(rows, full, key, F.xxhash64("word"))
        ready.append(told.where("h IS NULL").drop("h"))
        rows = told.where("h IS NOT NULL")
    parts = ready[0]
    for more in ready[1:]:
        parts = parts.unionByName(more)
    groups = max(1, -(-parts.count() // part_words))
    shape = "a string, a_n long, b string, b_n long"
    return parts.withColumn("group", F.pmod(F.xxhash64(*key), F.lit(groups))).groupBy("group").applyInPandas(_pairs, shape)


def word_forms(counts: DataFrame, least_chars: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n, for words (word, n) that occur at least `least` times.

    form: of the near words the one that occurs most (the smallest of several), if that is at least `ratio` times as often.
    """
    words = stash(counts.where((F.col("n") >= least) & (F.length("word") >= least_chars)), "words")
    pairs = near_pairs(words, least_chars)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{b}_n").alias("near_n"), F.col(b).alias("near"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    enough: Column = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    found = stash(found, "forms")
    return found.join(roots(found.where("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root, where the forms (word, form) followed from the word end. Every round follows twice as many at a time."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stash(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now
