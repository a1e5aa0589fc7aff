from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bathyal.llm import common
from bathyal.llm.manifest import folded, manifest, proof, tamper_check

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root, and for each leaf the siblings before and after on each level."""
    places, now, paths = list(range(len(nodes))), list(nodes), [[] for _ in nodes]
    while len(now) > 1:
        for leaf, i in enumerate(places):
            first = i - i % fanout
            paths[leaf].append((now[first:i], now[i + 1 : first + fanout]))
            places[leaf] = i // fanout
        now = [hashed("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)]
    return now[0], paths


def brute(rows: list[tuple], fanout: int) -> list[tuple]:
    def leaf(row):
        return hashed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([t[2] for t in sorted(trees[s], key=lambda t: t[:3])], fanout) for s in names}
    root, tops = tree([built[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, own, row), path in zip(sorted(trees[s], key=lambda t: t[:3]), built[s][1], strict=True):
            text = row[4]
            if text is not None and zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*row[:4], text))
            for before, after in path + top:
                node = hashed("".join(before) + node + "".join(after))
            siblings = "".join("".join(before + after) for before, after in path + top)
            out.append((row[0], own, built[s][0], root, hashed(siblings), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout, levels", [(3, 5), (3, 1), (2, 2), (7, 1)])
def test_against_brute_force(docs, fanout, levels):
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    assert sorted((tuple(r) for r in tamper_check(docs, fanout, levels).collect()), key=repr) == brute(rows, fanout)


@pytest.mark.parametrize("sizes", [(1,), (1, 1, 1, 1), (9, 27, 28, 2, 4, 0, 244)])
def test_ragged_runs_hot_sources_and_odd_names(spark, monkeypatch, sizes):
    names = [None, "", "-", "=", "é", "z", "\U0001f600"]
    rows = [(s * 1000 + i, names[s], None, i, f"a\nb{i}" if i % 2 else "\n") for s, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    want = brute(rows, 3)
    assert sorted((tuple(r) for r in tamper_check(frame, 3, 2).collect()), key=repr) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted((tuple(r) for r in tamper_check(frame, 3, 2).collect()), key=repr) == want


def test_paths_prove_rows_and_keep_other_columns(spark):
    leaves = spark.range(100).select(F.col("id").cast("string").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(5).alias("index_of"))
    made = manifest(leaves, fanout=4, levels=2)
    rows = made.select("*", folded(F.col("path"), F.col("leaf")).alias("up"), proof(F.col("path")).alias("proof")).collect()
    assert {r.up for r in rows} == {rows[0].root} == {rows[0].subroot} and all(r.index_of == 5 for r in rows)
    assert sorted(r["index"] for r in rows) == list(range(100)) and all(len(r.proof) % 64 == 0 for r in rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["index"])] == sorted(str(i) for i in range(100))


def test_empty_table(empty):
    assert tamper_check(empty).count() == 0
