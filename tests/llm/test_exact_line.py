from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from bathyal.llm import exact_dedup as exact_dedup_module
from bathyal.llm.exact_dedup import exact_dedup, keep_one_of_each
from bathyal.llm.line_dedup import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup_against_brute_force(docs, table, digest_bytes):
    """With one byte of digest many texts collide; comparing whole texts keeps them apart."""
    groups = defaultdict(list)
    for i, t in table:
        groups[(t or "").translate(LOWER)].append(i)
    want = []
    for i, t in table:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(docs, digest_bytes).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_hot_group(spark):
    rows = [(i, "Same" if i % 3 else f"other {i}") for i in range(3000)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(r.kept for r in got.values()) == 1001 and got[1].keep_id == 2999 and got[1].group_size == 2000


def test_exact_dedup_in_many_chunks(docs, table, monkeypatch):
    """Results don't depend on what is combined locally."""
    want = sorted((tuple(r) for r in exact_dedup(docs).collect()), key=repr)
    monkeypatch.setattr(exact_dedup_module, "CHUNK_BYTES", 1)
    got = sorted((tuple(r) for r in exact_dedup(docs.repartition(9)).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("parts, digest_bytes", [(1, 32), (3, 32), (4, 1)])
def test_keep_one_of_each_keeps_one_row_of_each(spark, docs, table, parts, digest_bytes):
    kept = keep_one_of_each(docs.repartition(parts), digest_bytes)
    assert kept.columns == docs.columns
    best = {}
    for i, t in table:
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    got = [((r.text or "").translate(LOWER), -1 if r.doc_id is None else r.doc_id) for r in kept.collect()]
    assert sorted(got) == sorted(best.items())


def test_keep_one_of_each_of_repeated_ids(spark):
    rows = [(4, "same text"), (4, "same text"), (4, "other"), (9, "SAME text"), (7, "aaa"), (7, "aaa"), (None, "x"), (None, "X"), (None, "y")]
    for parts in (1, 5):
        kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [("4", "other"), ("7", "aaa"), ("9", "same text"), ("None", "x"), ("None", "y")]


def brute_lines(table, min_chars=40, min_docs=5):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in table:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in table:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_against_brute_force(docs, table):
    got = [tuple(r) for r in line_dedup(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(table), key=repr)
    assert sum(r[2] for r in got) == 12


def test_line_dedup_plan_is_native(docs, empty):
    plan = line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert line_dedup(empty).count() == 0
