from __future__ import annotations

import math
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from bathyal.llm import minhash, neighbours
from bathyal.llm.bytestext import SLICE_BYTES, slices, span_hashes, words
from bathyal.llm.queries import op5_neighbours

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(table, size, percent=80):
    sets = {}
    for i, t in table:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for a, b in combinations(sorted(ids), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i) if i is not None else None) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_against_brute_force(docs, table, size):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs, size).collect()}
    assert got == brute_groups(table, size)


def test_near_groups_chain(spark, monkeypatch):
    """A chain in which only neighbours are similar enough, and blocks of two members."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rng = random.Random(5)
    text, rows = [f"w{rng.randrange(10**6)}" for _ in range(60)], []
    for i in range(30):
        rows.append((i, " ".join(text)))
        at = rng.randrange(60)
        text[at] = f"n{i}"
    rows += [(100 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute_groups(rows, 2)


def test_near_groups_empty_and_kept(docs, empty):
    assert minhash.near_groups(empty).count() == 0
    kept = minhash.keep_one_of_group(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_sketch_limit_lets_similar_pairs_pass():
    rng = np.random.default_rng(0)
    limit = minhash.sketch_limit(80)
    assert 0 < limit < minhash.SKETCH_BITS / 2
    differ = rng.binomial(minhash.SAMPLES, 0.2, 2000)
    seen = [np.bincount(rng.integers(0, minhash.SKETCH_BITS, 2 * d), minlength=minhash.SKETCH_BITS) % 2 for d in differ]
    assert np.mean([s.sum() <= limit for s in seen]) > 0.999


def test_set_sketches_let_similar_pairs_pass():
    rng = np.random.default_rng(1)
    passed = []
    for n in (20, 300, 3000):
        for _ in range(200):
            shared, mine, other = (rng.integers(0, minhash.SET_BITS, k) for k in (n, n // 8, n // 8))  # similarity 0.8
            x, y = (np.bincount(np.concatenate([shared, p]), minlength=minhash.SET_BITS) % 2 for p in (mine, other))
            pack = lambda b: np.packbits(np.concatenate([np.zeros(minhash.SKETCH_BITS, np.uint8), b.astype(np.uint8)])).view(np.uint64)[None]
            size = np.array([n + n // 8])
            passed.append(minhash.sketches_near(pack(x), pack(y), size, size, 80)[0])
    assert np.mean(passed) > 0.998


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.doc_id: r.component for r in minhash.components(path).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_words_of_slices():
    texts = ["a bc", "", None, "  x\ty ", "z" * (SLICE_BYTES + 5), "q"]
    found = []
    for part in slices(pa.array(texts)):
        s, e, b = words(part)
        h = span_hashes(part.data, s, e)
        assert len(set(h.tolist())) == len({part.data[i:j].tobytes() for i, j in zip(s, e)})
        found += [[part.data[s[k] : e[k]].tobytes().decode() for k in range(b[i], b[i + 1])] for i in range(part.last - part.first)]
    assert found == [WORD.findall(t or "") for t in texts]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_long_texts_lose_no_shingle_between_pieces(size, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'abcdefg'[rng.integers(7)]}{rng.integers(50)}" for _ in range(n)) for n in (0, 1, 2, 5, 3000, 7, 1)] + [None, "x" * 9000, " \n" * 4000 + "one two", "a b c d e f g h"]
    whole = [s.tolist() for _, _, sets in minhash.text_sets(pa.array(texts), size) for s in sets]
    monkeypatch.setattr(minhash, "slices", lambda column, split: slices(column, 100, split))
    pieces = [s.tolist() for _, _, sets in minhash.text_sets(pa.array(texts), size) for s in sets]
    assert pieces == whole and len(whole) == len(texts)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int")


def brute_neighbours(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8]
    return {i: [j for _, j in sorted((-float(v @ w), j) for j, w in good if j != i)[:k]] for i, v in good if i % every == 0}


def test_neighbours_find_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 300)
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (None, [1.0] * 8), (2080, [1.0] * 3)]
    longest = max(rows[:1200], key=lambda r: np.linalg.norm(r[1]))
    rows += [(3000 + i, longest[1]) for i in range(30)]  # ties, and no inner product with them is larger
    want = brute_neighbours(rows, 20, 20)
    got = {}
    for r in neighbours.nearest_neighbours(vectors(spark, [(i, v, 0, 0.0, 0) for i, v in rows]), 20, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9
    assert got[3000] == want[3000] == [longest[0], *range(3001, 3020)]  # equal scores by id


def test_neighbours_few_and_none(spark):
    few = vectors(spark, [(i, [float(i + 1), 1.0], 0, 0.0, 0) for i in range(5)])
    assert [r.vec_id for r in neighbours.nearest_neighbours(few).orderBy("rank").collect()] == [4, 3, 2, 1]
    assert neighbours.nearest_neighbours(few.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [
    [(0, [1e-170, 0.0]), (1, [1e-170, 1e-170]), (2, [2e-170, 0.0])],
    [(0, [1.0, 0.0]), (1, [1e200, 0.0]), (2, [0.0, 1.0])],
    [(0, [1.7e308, 1.7e308]), (1, [1.7e308, -1.7e308]), (2, [1e-300, 1.0])],
])
def test_neighbours_of_extreme_vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in neighbours.nearest_neighbours(frame, 20, 5).orderBy("rank").collect()]
    assert sorted(i for i, _ in got) == [1, 2] and got[0][1] >= got[1][1]


def test_neighbours_of_a_repeated_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        assert [(r.vec_id, r.score) for r in neighbours.nearest_neighbours(frame, 20, 5).orderBy("rank").collect()] == [(2, 3.0), (1, 1.0)]


def test_neighbours_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, v = np.array([i for i, _ in rows]), np.vstack([x for _, x in rows])
    got = op5_neighbours(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for n in np.flatnonzero(ids % 20 == 0):
        s = v @ v[n]
        s[n] = -9
        hits.append(len(got[ids[n]] & set(ids[np.argsort(-s)[:20]])) / 20)
    assert np.mean(hits) >= 0.9
