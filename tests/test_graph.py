"""Components against a walk over all edges."""

from __future__ import annotations

import numpy as np
import pandas as pd

from bathyal.operators import graph


def _components(n, edges):
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def test_components_of_chains_and_random_edges(spark, monkeypatch):
    """Chains up, down and shuffled, loops, doubled edges and lone nodes; a chain's edges are drawn again once, not at every doubling."""
    rng = np.random.default_rng(2)
    shuffled = rng.permutation(np.arange(80, 120))
    edges = [(i, i + 1) for i in range(39)] + [(i + 1, i) for i in range(40, 79)] + list(zip(shuffled, shuffled[1:]))
    edges += [tuple(e) for e in rng.integers(120, 200, (50, 2))] + [(5, 5), (7, 6), (6, 7)]
    edges = [(int(a), int(b)) for a, b in edges]
    frame = lambda rows, names: spark.createDataFrame(pd.DataFrame(rows, columns=names))
    got = graph.components(frame([(i,) for i in range(205)], ["id"]), frame(edges, ["a", "b"])).collect()
    assert sorted((r.id, r.component) for r in got) == list(enumerate(_components(205, edges)))
    written, saved = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: written.append(df.columns) or saved(df))
    graph.components(frame([(i,) for i in range(40)], ["id"]), frame(edges[:39], ["a", "b"]))
    assert written.count(["a", "b"]) == 2 and written.count(["id", "component"]) == 1


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """Tables of a round are small here, yet no join sends one through the driver."""
    from pyspark.sql import functions as F

    from bathyal.operators import areas, graph

    plans = []
    write = graph.saved

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "saved", kept)
    monkeypatch.setattr(areas, "saved", kept)
    cells = spark.range(60).select((F.col("id") % 10).alias("row"), F.floor(F.col("id") / 10).alias("col"), F.lit(1).alias("class"))
    facts, corners = areas.rings(areas.regions(cells, tile=4))
    assert facts.count() == 1 and corners.count() == 4
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
