from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import combinations, product
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bathyal.llm import packing
from bathyal.llm.mixing import mix, mix_plan, source_targets
from bathyal.llm.sharding import byte_shards
from bathyal.llm.subwords import multi_subwords, subwords

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def check_ids(texts, tokenizer):
    got = []
    for first, last, ids, bounds in subwords().encode(pa.array(texts, pa.string())):
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(last - first)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_subwords_equal_the_tokenizer(tokenizer, table):
    check_ids([t for _, t in table if t is None or len(t) < 5000], tokenizer)
    check_ids(["a  ", " b", "x\n\ny", "x \ny", "it's 's  'll", "é x  y", "日本 語　 x", "a\tb \t c", "\x1c x", "x\x85 y", " ", "\r\n a", "<|endoftext|> q"], tokenizer)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'é1.! 　x", max_size=30), max_size=6))
def test_subwords_equal_the_tokenizer_anywhere(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    check_ids(texts, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        n, window = rng.randint(1, 9), 10
        places = np.concatenate([[0], np.cumsum([rng.randint(1, window) for _ in range(n)])])
        penalties = np.array([0.0] + [rng.choice([0.0, 4.0, 64.0]) for _ in range(n)])

        def cost(ix, places=places, penalties=penalties):
            return sum(penalties[j] + window - (places[j] - places[i]) for i, j in zip(ix, ix[1:]))

        ways = ([0, *m, n] for k in range(n) for m in combinations(range(1, n), k))
        best = min(cost(w) for w in ways if all(places[j] - places[i] <= window for i, j in zip(w, w[1:])))
        cuts = packing.best_cuts(places, penalties, window)
        assert abs(cost([int(np.searchsorted(places, c)) for c in cuts]) - best) < 1e-9


@pytest.mark.parametrize("segment", [1 << 20, 600])
def test_packing_round_trip(docs, table, tokenizer, monkeypatch, segment):
    """Each id lies in one piece, in order; windows are full but for little; segments of any size lose nothing."""
    monkeypatch.setattr(packing, "SEGMENT", segment)
    pieces = packing.pack(docs.coalesce(1), window=256).collect()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    texts = defaultdict(list)
    for i, t in table:
        texts[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for i, all_ids in texts.items():
        ps = sorted(by_doc[i], key=lambda p: (p.sequence_id, p.offset))
        for ids in all_ids:
            at = 0
            while at < len(ids):
                p = next(p for p in ps if p.start == at)
                assert p.doc_tokens == len(ids)
                assert p.ids_crc32 == crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                ps.remove(p)
                at += p.length
        assert not ps
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_shards(docs, table, empty):
    got = byte_shards(docs, 6).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), crc32((t or "").encode())) for i, t in table)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in order]
    assert keys == sorted(keys)
    total, start = sum(r.size for r in got), 0
    for r in order:
        assert r.shard == min(5, int((2 * start + r.size) * 6 / (2 * total)))
        start += r.size
    for s in range(6):
        slots = [r.slot for r in order if r.shard == s]
        assert slots == list(range(len(slots)))
    assert byte_shards(empty).count() == 0


def test_shards_are_balanced(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 101).cast("int")).alias("text"))
    bytes_ = [r[1] for r in byte_shards(rows, 40).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(bytes_) == 40 and max(bytes_) - min(bytes_) <= 2 * 117


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_by_resharing(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 5, 50, 400]) for s in ["b", "a", "ß", None, "Z", "c"]} | {"d": 100}
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in source_targets(frame, (3, 1, 2), 1.5, 2.0).collect()}
        want = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_mix(docs, table, empty):
    plan = mix_plan(docs).collect()
    assert {(str(r.doc_id), r.size) for r in plan} == {(str(i), len(WORD.findall(t or ""))) for i, t in table}
    assert all(0 <= r.copies <= 2 for r in plan)
    again = {(r.doc_id, r.source): r.copies for r in mix_plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.source): r.copies for r in plan}
    by = defaultdict(list)
    for r in plan:
        by[r.source].append(r)
    for rows in by.values():
        taken = sum(r.copies * r.size * r.n_rows for r in rows)
        assert abs(taken - rows[0].target) <= max(r.size * r.n_rows for r in rows)
    mixed = mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies * r.n_rows for r in plan)
    assert mix(empty).count() == 0


def test_mix_slices_do_not_matter(spark):
    rows = [(i, " ".join("w" * (i * 13 % 50 + 1)), "hot" if i % 3 else f"s{i % 7}") for i in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few, many = ({r.doc_id: r.copies for r in mix_plan(frame, slices=n).collect()} for n in (1, 4096))
    assert few == many and len(list(product(few))) == 800


def test_mix_prefers_long_documents(spark):
    """Inclusion odds rise with the number of binary digits of the size, and words meet the target all the same."""
    rows = [(i, " ".join("w" * (2 if i % 2 else 200)), "a" if i % 10 else "b") for i in range(8000)]
    plan = [r for r in mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(2, 3)).collect() if r.source == "a"]
    assert abs(sum(r.copies * r.size for r in plan) - plan[0].target) <= 100
    extra = {n: np.mean([r.copies for r in plan if r.size == n]) - int(plan[0].target / plan[0].source_size) for n in (2, 200)}
    odds = {n: s / (1 - s) for n, s in extra.items()}
    assert 0 < extra[2] < extra[200] < 1 and 3 < odds[200] / odds[2] < 5.5  # 8 digits to 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters=" \t\n\x0b\x0c\r"), min_size=1, max_size=8), max_size=20))
def test_words_encoded_in_one_call(words):
    """Words have the ids that each has alone with a space in front, other white space within them or not."""
    encoder = multi_subwords()
    found = encoder._encoded_words([w.encode() for w in words])
    want = [encoder.encoding.encode_ordinary(" " + w) for w in words]
    if found is not None:
        cuts = np.concatenate([[0], np.cumsum(found[1])])
        assert [found[0][a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want


def test_words_with_other_white_space():
    encoder = multi_subwords()
    words = ["a\u00a0", "b", "\u2003c", "\u00e4\u00f6", "d\u3000\u00a0", "\u0085", "e"]
    ids, n = encoder._encoded_words([w.encode() for w in words])
    assert ids.tolist() == [i for w in words for i in encoder.encoding.encode_ordinary(" " + w)] and n.sum() == len(ids)
