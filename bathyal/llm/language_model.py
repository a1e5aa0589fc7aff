"""Language-model scores: a causal self-attention model over subword ids, beside a word-frequency base.

A text is its lower-cased words as ids of a public subword vocabulary, a space in front of each word, and an end id. Texts are
encoded once; ids are kept in the shared folder, from where counting, training and scoring read them.

Model (attention.py): its tables hold a row for each id that the training texts use and one for all others, which share its
probability evenly. It is trained in numpy by local descent: in each of ROUNDS rounds every partition takes steps on its own
training texts, each window exactly once in all rounds, beginning from the model of the round before; the partitions' models
are averaged in Spark, weighted by ids, as a tree of block sums. A text's score is the sum of the log10 probabilities of all
its ids, its end among them, in windows that overlap: each id counts once, in the first window that reaches it.

Base: a word is a run of ids that begins with a space, hashed to 64 bits, and counted over all training texts. The most
frequent words, HEAD at most, go to all tasks in a table of fixed size; a text's other distinct words meet their counts in a
join, so every count is exact.

Defined cases: a null or empty text is its end alone. Rows that repeat a document are scored alike, and learnt from as often.
Without training texts counts are 0 and all ids are alike to the model. An empty table gives an empty result. Other columns
are ignored. Words are told apart by 64-bit hashes. A text longer than a slice is encoded in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import BATCH, OVERLAP, WINDOW, Attention, window_ids, windows
from .bytestext import ASCII_LOWER, group_sums, slices, span_hashes, words
from .common import BLOCKS, arrow_rows, block_sums, blocks_of, remainder, stash
from .subwords import multi_subwords

MODULUS, HELD_OUT = 5, 1
ROUNDS = 2
#: Local models that are trained at a time; with more partitions, a task goes on with its model from one to the next.
LOCAL_MODELS = 4096
#: Words that all tasks hold, and the places of their table.
HEAD, SLOTS = 1 << 17, 1 << 19
MERGE_AT = 2 << 20
END, IDS = 50256, 50257
PIECE_BYTES = 1 << 20
#: Rows that go to Python at a time.
ROWS = 1000


def encoded(docs: DataFrame) -> DataFrame:
    """rid (a number for each row), doc_id, learn, and the ids of each text (16 bits each, without the end); docs has doc_id, text, learn."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, begun = multi_subwords(), TaskContext.get().partitionId() << 33, []
        for batch in batches:
            for part in slices(batch.column("text"), split=True):
                starts, ends, bounds = words(part)
                low = ASCII_LOWER[part.data]
                where, k = encoder.located(low, starts, ends, span_hashes(low, starts, ends), b" ")
                total = np.concatenate([[0], np.cumsum(k)])
                index = np.repeat(where - total[:-1], k)
                index += np.arange(len(index))
                raw, cuts = memoryview(encoder.held[index].tobytes()), (2 * total[bounds]).tolist()
                if part.last == part.first:  # the text goes on
                    begun.append(bytes(raw))
                    continue
                found = [bytes(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if begun:
                    found[0] = b"".join([*begun, found[0]])
                    begun = []
                n = part.last - part.first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), batch.column("doc_id").slice(part.first, n), batch.column("learn").slice(part.first, n), pa.array(found, pa.binary())],
                    names=["rid", "doc_id", "learn", "ids"],
                )
                row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stash(docs.select("doc_id", "text", "learn").mapInArrow(encode, f"rid long, doc_id {kind}, learn boolean, ids binary"), "encoded")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece's ids take PIECE_BYTES, or one row's."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE_BYTES, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _with_end(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, each row's followed by the end id, and their bounds."""
    rows, end = batch.column("ids").to_pylist(), END.to_bytes(2, "little")
    lengths = np.array([len(r) // 2 + 1 for r in rows], np.int64)
    return np.frombuffer(b"".join(x for r in rows for x in (r, end)), np.uint16), np.concatenate([[0], np.cumsum(lengths)])


def word_hashes(ids: np.ndarray, bounds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and how many words stand before each text and after the last. begins: which ids begin with a space."""
    starts = np.flatnonzero(begins[ids])
    ends = np.flatnonzero(np.append(begins[ids] | (ids == END), True))
    ends = ends[np.searchsorted(ends, starts, side="right")] if len(starts) else starts
    return span_hashes(ids, starts, ends), np.searchsorted(starts, bounds)


# ---- counts -----------------------------------------------------------------------------------------------------------


def counts_of(tokens: DataFrame) -> DataFrame:
    """is_id, key and n: how often each id, and each word by its hash, is there."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        begins, seen = multi_subwords().begins, np.zeros(IDS, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

        def batch_of(is_id: bool, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), is_id)), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["is_id", "key", "n"])

        for batch in _pieces(batches):
            ids, bounds = _with_end(batch)
            seen += np.bincount(ids, minlength=IDS)
            held.append(np.unique(word_hashes(ids, bounds, begins)[0], return_counts=True))
            if sum(len(h) for h, _ in held) > MERGE_AT:
                held[:] = [merged()]
                if len(held[0][0]) > MERGE_AT // 2:
                    yield batch_of(False, *held.pop())
        if held:
            yield batch_of(False, *merged())
        used = np.flatnonzero(seen)
        yield batch_of(True, used, seen[used])

    parts = tokens.select("ids").mapInArrow(partial, "is_id boolean, key long, n long")
    return stash(parts.groupBy("is_id", "key").agg(F.sum("n").alias("n")), "counts")


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The words found `least` times or more, where `least` is as low as HEAD words allow: a table of hashes and their counts
    by the low bits of the hash, and `least`. Of words that meet in one place the more frequent one has it."""
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(HEAD).collect()
    least, total = 0, 0
    for n, kinds in levels:
        total += kinds
        if total > HEAD:
            break
        least = n
    keys, n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
    if least:
        top = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "key"])  # HEAD rows at most
        h = top["key"].to_numpy(np.int64).view(np.uint64)
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        keys[at], n[at] = h, top["n"].to_numpy(np.int64)
    return keys, n, least


# ---- training ---------------------------------------------------------------------------------------------------------


def trained(tokens: DataFrame, shares: np.ndarray, rank: np.ndarray) -> Attention:
    """A model that has seen every window of tokens once. rank: the number of each id among the model's."""
    model, spark = Attention(shares), tokens.sparkSession
    tokens = tokens.select("ids", F.pmod(F.xxhash64("rid"), F.lit(ROUNDS)).alias("turn")).coalesce(LOCAL_MODELS)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.flat(), shares, rank))

        def local(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, turn: int = turn) -> Iterator[pa.RecordBatch]:
            flat, shares, rank = sent.value
            part = TaskContext.get().partitionId()
            mine, rng, seen = Attention(shares), np.random.default_rng((turn, part)), 0
            mine.load(flat)
            for batch in _pieces(batches):
                ids, bounds = _with_end(batch)
                y = rank[ids]
                x = _shifted(y, bounds, rank[END])
                start, end, _ = windows(bounds, WINDOW)
                order = rng.permutation(len(start))
                for i in range(0, len(order), BATCH):
                    w = order[i : i + BATCH]
                    mine.step(*window_ids(y, x, start[w], end[w])[:3])
                seen += len(ids)
            if seen:
                yield blocks_of(mine.flat().astype(np.float64) * seen, seen, part)

        sums = block_sums(tokens.where(F.col("turn") == turn).select("ids").mapInArrow(local, BLOCKS))
        if sums is not None:
            model.load(sums[1] / sums[0])
        sent.destroy()
    return model


def _shifted(y: np.ndarray, bounds: np.ndarray, end: int) -> np.ndarray:
    """The id before each position; the end id before a text."""
    x = np.concatenate([y[-1:], y[:-1]])
    x[bounds[:-1]] = end
    return x


# ---- scores -----------------------------------------------------------------------------------------------------------


def text_scores(model: Attention, ids: np.ndarray, bounds: np.ndarray, rank: np.ndarray, rest: float) -> np.ndarray:
    """The log10 probability of each text. rest: how many ids share the probability of the model's last one."""
    y = rank[ids]
    x = _shifted(y, bounds, rank[END])
    start, end, opens = windows(bounds, WINDOW - OVERLAP)
    each = np.where(y == len(model.tier) - 1, -math.log(rest), 0.0)
    fresh = np.arange(WINDOW) >= OVERLAP
    for i in range(0, len(start), BATCH):
        some = slice(i, i + BATCH)
        xs, ys, use, at = window_ids(y, x, start[some], end[some])
        found, lp = model.log_probabilities(xs, ys, use & (fresh | opens[some, None]))
        each[at.ravel()[found]] += lp
    return group_sums(each, bounds) / math.log(10)


SCORED = "rid long, doc_id {kind}, learn boolean, n_tokens long, head_known long, head_sum double, score double, others long, words array<long>, times array<int>"


def scored(tokens: DataFrame, model: Attention, shares: np.ndarray, rank: np.ndarray, head: tuple[np.ndarray, np.ndarray], ends: int) -> DataFrame:
    """For each row: the model's score, sums over its end and its frequent words, and its other words and how often each is there."""
    keys, n = head
    sent = tokens.sparkSession.sparkContext.broadcast((model.flat(), shares, rank, keys, n))
    log_end = math.log10(ends + 0.5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, shares, rank, keys, n = sent.value
        mine, begins = Attention(shares), multi_subwords().begins
        mine.load(flat)
        logs = np.log10(n + 0.5)
        for batch in _pieces(batches):
            ids, bounds = _with_end(batch)
            h, at = word_hashes(ids, bounds, begins)
            slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
            hit = (keys[slot] == h) & (n[slot] > 0)
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(at))[~hit]
            order = np.lexsort((h[~hit], text))
            rare, text = h[~hit][order], text[order]
            new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (text[1:] != text[:-1])])) if len(rare) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(rare)))
            cuts = pa.array(np.searchsorted(text[new], np.arange(len(bounds))), pa.int32())
            known = group_sums(hit.astype(float), at).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("rid", "doc_id", "learn")),
                    pa.array(np.diff(at) + 1),
                    pa.array(known + (ends > 0)),
                    pa.array(group_sums(np.where(hit, logs[slot], 0.0), at) + log_end),
                    pa.array(text_scores(mine, ids, bounds, rank, IDS - len(shares) + 1)),
                    pa.array(np.diff(at) - known),
                    pa.ListArray.from_arrays(cuts, pa.array(rare[new].view(np.int64))),
                    pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
                ],
                names=[x.split()[0] for x in SCORED.split(", ")],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return stash(tokens.select("rid", "doc_id", "learn", "ids").mapInArrow(score, SCORED.format(kind=kind)), "scored")


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for each row of docs."""
    with arrow_rows(docs.sparkSession, ROWS):
        return _lm_scores(docs)


def _lm_scores(docs: DataFrame) -> DataFrame:
    tokens = encoded(docs.select("doc_id", "text", (remainder(F.col("doc_id"), MODULUS) != HELD_OUT).alias("learn")))
    counts = counts_of(tokens.where("learn"))
    counted, words_of = counts.where("is_id"), counts.where("not is_id").select("key", "n")
    used = counted.select("key", "n").orderBy(F.col("n").desc(), "key").toPandas()  # a row for each id of the vocabulary at most
    ends = int(used.loc[used["key"] == END, "n"].sum())
    n, kinds = words_of.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, kinds = n + ends, kinds + (ends > 0)
    rank = np.full(IDS, len(used), np.int32)
    rank[used["key"].to_numpy(np.int64)] = np.arange(len(used))
    shares = np.append(used["n"].to_numpy(np.float64), 0) + 0.5
    shares /= shares.sum()
    keys, key_counts, least = frequent_words(words_of)

    model = trained(tokens.where("learn"), shares, rank)
    rows = scored(tokens, model, shares, rank, (keys, key_counts), ends)
    rare = rows.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("key"), F.col("w.times").alias("times"))
    met = rare.join(words_of, "key").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("rest_sum"), F.sum("times").alias("rest_known")
    )
    rest_known = F.coalesce("rest_known", F.lit(0))
    base = (
        F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) + (F.col("others") - rest_known) * math.log10(0.5)
        - F.col("n_tokens") * math.log10(n + 0.5 * (kinds + 1))
    )
    return rows.join(met, "rid", "left").select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + rest_known).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
