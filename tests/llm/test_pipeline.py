from __future__ import annotations

from collections import Counter
from zlib import crc32

import corpus_pipeline
from bathyal.llm.language import REJECT
from bathyal.llm.mixing import mix_plan

from .test_exact_line import LOWER
from .test_pairs import brute_groups
from .test_scores import brute_languages


def test_stages_against_brute_force(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, now, "").collect(), docs.schema)
        before, after = Counter(r.doc_id for r in now.collect()), Counter(r.doc_id for r in out.collect())
        assert out.columns == docs.columns
        if name == "language_id":
            rows = now.collect()
            train = [(r.lang, r.text) for r in rows if crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 != 1]
            found = brute_languages([r.text for r in rows], train)
            assert after == Counter(r.doc_id for r, (lang, score) in zip(rows, found) if lang != "und" and score >= REJECT)
        elif name == "exact_dedup":
            best = {}
            for r in now.collect():
                key = (r.text or "").translate(LOWER)
                best[key] = max(best.get(key, -1), -1 if r.doc_id is None else r.doc_id)
            assert after == Counter(None if i == -1 else i for i in best.values())
        elif name == "near_dedup":
            groups = brute_groups([(r.doc_id, r.text) for r in now.collect()], 5)
            assert set(after) == {i for i in before if i is None or groups[i][1] == i}
        else:
            plan = {r.doc_id: r.copies * r.n_rows for r in mix_plan(now).collect()}
            assert after == Counter({i: n for i, n in plan.items() if n})
        now = out
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert set(r.doc_id for r in packed) == set(r.doc_id for r in now.collect())


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
