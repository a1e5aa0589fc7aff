from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bathyal.llm.bytestext import slices
from bathyal.llm.variants import counted, near_pairs, trie_pairs, word_counts, word_forms


def near(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_counts(rows, every, least):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    return dict(count)


def brute_forms(n: dict[str, int], ratio: int):
    close = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(close[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n)


def test_trie_pairs_of_small_alphabets():
    """Runs of one character, prefixes of one another and the empty word: every pair once."""
    rng = random.Random(7)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abé"[: rng.choice([2, 3])]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 40))})
        a, b = trie_pairs(np.zeros(len(words), int), words, np.full(1, -1), np.full(1, 99))
        got = sorted(sorted((words[i], words[j])) for i, j in zip(a, b, strict=True))
        assert got == [[x, y] for i, x in enumerate(words) for y in words[i + 1 :] if near(x, y)]


@pytest.mark.parametrize("part_words", [8, 1 << 15])
def test_near_pairs_with_parts_of_any_size(spark, part_words):
    rng = random.Random(part_words)
    words = sorted({"thesame" * (i % 3 == 0) + "".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for i in range(150)})
    frame = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long").repartition(3)
    got = [(r.a, r.a_n, r.b, r.b_n) for r in near_pairs(frame, 6, part_words).collect()]
    assert all(n == len(w) and m == len(x) for w, n, x, m in got)
    assert sorted(sorted((w, x)) for w, _, x, _ in got) == [[w, x] for i, w in enumerate(words) for x in words[i + 1 :] if near(w, x)]


def test_near_pairs_of_short_and_very_long_words(spark):
    words = ["", "a", "b", "ab", "abc", "x" * 3_000, "x" * 2_999, "x" * 2_999 + "y"]
    for part_words in (3, 100):
        got = near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 1, part_words).collect()
        assert sorted(sorted((r.a, r.b)) for r in got) == sorted(sorted((w, x)) for i, w in enumerate(words) for x in words[i + 1 :] if near(w, x))


def test_checksums_and_counts_in_small_slices(table):
    rows = [*table, (10**12, "Wörter À×÷ÿ Ābcdefg " * 50 + "y" * 500 + "Z" * 63 + " " + "q" * 64 + " " + "r" * 65), (None, None)]
    for size in (64, 1 << 20):
        got = collections.Counter()
        for part in slices(pa.array([t for _, t in rows]), size, split=True):
            for batch in counted(part, [i for i, _ in rows][part.first : max(part.last, part.first + 1)], 5, 3):
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    got[word] += n
        assert got == brute_counts(rows, 5, 3)


def test_forms_against_brute_force(docs, table):
    counts = word_counts(docs, every=3, least_chars=4)
    want = brute_counts(table, 3, 4)
    assert {r.word: r.n for r in counts.collect()} == want
    got = [tuple(r) for r in word_forms(counts, least_chars=4, least=1, ratio=2).collect()]
    assert sorted(got, key=repr) == sorted(brute_forms(want, 2), key=repr)


def test_forms_follow_chains_and_break_ties(spark):
    n = {"abcdef": 1000, "abcdeg": 200, "abcdfg": 30, "abzdfg": 4, "tttttt": 50, "ttttta": 50, "tttttb": 10, "alonehere": 7}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r.word: r for r in word_forms(counts, 6, 1, 5).collect()}
    assert got["abzdfg"].form == "abcdfg" and got["abzdfg"].root == "abcdef" and got["abcdef"].form is None
    assert got["tttttb"].form == "ttttta" and got["tttttb"].form_n == 50 and got["tttttb"].n_near == 2
    assert (got["alonehere"].root, got["alonehere"].n_near, got["alonehere"].form_n) == ("alonehere", 0, None)


def test_empty_tables(empty):
    assert word_forms(word_counts(empty)).count() == 0
    assert word_forms(word_counts(empty.select("doc_id", F.lit(None).cast("string").alias("text")))).columns == ["word", "form", "root", "n", "n_near", "form_n"]
