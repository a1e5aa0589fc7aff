from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bathyal.llm import attention, common, language, language_model, quality, subwords
from bathyal.llm.bytestext import slices
from bathyal.llm.queries import op2_quality, op6_language_id, op8_lm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    """n-grams of one to three signs of a text: letters, and one gap for each run of others; none has two gaps in a row."""
    s = "\0" + re.sub(r"[\W\d_]+", "\0", text.lower()) + "\0"
    s = re.sub("\0+", "\0", s)
    out = Counter(c for c in s if c != "\0")
    for n in (2, 3):
        out.update(s[i : i + n] for i in range(len(s) - n + 1))
    return out


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n + (1 << 62 if len(gram) == 2 else 0)


def ranked(counts):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language.PROFILE]


def brute_languages(table, train):
    """Language and score of each text of table, one n-gram after another; train: (lang, text)."""
    by = {}
    for lang, text in train:
        if lang and text and any(c.isalpha() for c in text):
            by.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in by.items()}
    out = []
    for text in table:
        if not text or not any(c.isalpha() for c in text) or not profiles:
            out.append(("und", 0.0))
            continue
        mine = ranked(grams(text))
        distance = {lang: sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(distance), key=lambda k: distance[k])
        out.append((best, 1 - distance[best] / (language.PROFILE * len(mine))))
    return out


def test_language_against_brute_force(spark, docs, table):
    """Ranks, distances, predictions and scores agree with plain Python."""
    rows = docs.collect()
    train = [(r.lang, r.text) for r in rows if crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 != 1]
    want = [(str(r.doc_id), *found) for r, found in zip(rows, brute_languages([r.text for r in rows], train))]
    got = [(str(r.doc_id), r.lang_pred, r.score) for r in language.language_id(docs).collect()]
    assert sorted((i, lang, round(s, 9)) for i, lang, s in got) == sorted((i, lang, round(s, 9)) for i, lang, s in want)


def test_language_rejects_what_it_has_not_learnt(spark, docs):
    other = spark.createDataFrame([(900, "\u0431\u044b\u0441\u0442\u0440\u0430\u044f \u043b\u0438\u0441\u0430 \u043f\u0440\u044b\u0433\u0430\u0435\u0442", None, None)], "doc_id long, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").union(other)
    kept = {r.doc_id for r in language.keep_known_language(both).collect()}
    assert 900 not in kept and {4, 5, 6} <= kept


def test_language_defined_cases(docs, empty):
    got = {r.doc_id: r for r in language.language_id(docs).collect()}
    assert got[1].lang_pred == "und" and got[2].lang_pred == "und" and got[1].score == 0
    assert all(r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert language.language_id(empty).count() == 0
    kept = language.keep_known_language(docs)
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 0


def test_language_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in op6_language_id(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got)


def test_isotonic_is_the_best_rising_fit():
    at = np.arange(6.0)
    y = np.array([0.0, 1.0, 0.0, 1.0, 1.0, 0.0])
    steps, levels = quality.isotonic(at, y, np.ones(6))
    assert np.all(np.diff(levels) >= 0) and np.allclose(steps, [0, 1.5, 4])


def test_fourier_features_approximate_the_kernel():
    model = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, quality.STATISTICS))
    phi = model.features(x)[:, : quality.FEATURES]
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(phi @ phi.T - np.exp(-d2 / 2 / quality.STATISTICS)).mean() < 0.08


def test_quality_defined_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(40)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} <= {s for s in (r.score for r in none) if 0.49 <= s <= 0.51}
    assert quality.quality_scores(empty, labels).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in op2_quality(spark, sf).collect() if r.held_out and r.doc_id in truth]
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([p == y for _, p, y in held]) > 0.9


def small_model(size=90, seed=1):
    rng = np.random.default_rng(seed)
    shares = np.sort(rng.random(size))[::-1]
    model = attention.Attention(shares / shares.sum())
    model.p = {k: (v + rng.normal(size=v.shape) * 0.3).astype(np.float64) for k, v in model.p.items()}
    return model, rng


def plain_log_probabilities(model, x, y):
    """One position after another, all ids at once: the chance of the tier times that within the tier."""
    p, w = model.p, attention.WIDTH
    own, value, query, key = np.split(p["table"], np.cumsum([w, w, attention.KEYS]), axis=1)
    out = np.zeros(x.shape)
    for b in range(len(x)):
        for t in range(x.shape[1]):
            past = x[b, : t + 1]
            a = np.exp([query[x[b, t]] @ key[j] + p["lag"][t - i] for i, j in enumerate(past)])
            h = np.append(own[x[b, t]] + (a / a.sum()) @ value[past], 1.0)
            z = p["out"] @ h
            first = z[: model.ends[0] + model.tiers]
            target, tier = y[b, t], model.tier[y[b, t]]
            out[b, t] = first[model.first[target]] - np.log(np.exp(first).sum())
            if tier:
                part = z[model.tiers + model.ends[tier - 1] : model.tiers + model.ends[tier]]
                out[b, t] += part[target - model.ends[tier - 1]] - np.log(np.exp(part).sum())
    return out


def test_quality_against_dense_fit(spark, sf):
    """Weights and calibration are those of a dense ridge fit and of pooled neighbours on one machine."""
    rng = np.random.default_rng(2)
    n = 900
    x = rng.normal(size=(n, quality.STATISTICS)) * rng.uniform(0.5, 3, quality.STATISTICS) + 1
    y = (x[:, 0] + x[:, 1] ** 2 / 4 + rng.normal(size=n) > 2).astype(int)
    fold = rng.integers(0, quality.CALIBRATE, n)
    rows = [(x[i].tolist(), int(y[i]), int(fold[i])) for i in range(n)]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, y long, fold long").repartition(5))
    plain = quality.Model(x.mean(axis=0), x.std(axis=0))
    fits, held = fold > 0, fold == 0
    phi = plain.features(x[fits])
    penalty = np.full(phi.shape[1], quality.RIDGE * fits.sum())
    penalty[-1] = 1e-6
    plain.weights = np.linalg.solve(phi.T @ phi + np.diag(penalty), phi.T @ y[fits])
    assert np.allclose(model.weights, plain.weights, rtol=1e-6, atol=1e-9)
    bins = np.round(plain.raw(x[held]) * quality.BINS).astype(int)
    at = np.unique(bins)
    sums, counts = (np.array([f(y[held][bins == b]) for b in at], float) for f in (np.sum, len))
    blocks = [[b / quality.BINS * c, s, c] for b, s, c in zip(at, sums, counts)]
    while any(p[1] * q[2] >= q[1] * p[2] for p, q in zip(blocks, blocks[1:])):  # pools the first pair that doesn't rise
        i = next(i for i, (p, q) in enumerate(zip(blocks, blocks[1:])) if p[1] * q[2] >= q[1] * p[2])
        blocks[i : i + 2] = [[a + b for a, b in zip(blocks[i], blocks[i + 1])]]
    b = np.array(blocks)
    assert np.allclose(model.steps, b[:, 0] / b[:, 2]) and np.allclose(model.levels, (b[:, 1] + 0.25) / (b[:, 2] + 0.5))


def test_attention_against_plain_loops():
    model, rng = small_model()
    x, y = rng.integers(0, 90, (3, attention.WINDOW)), rng.integers(0, 90, (3, attention.WINDOW))
    use = rng.random(x.shape) < 0.7
    at, lp = model.log_probabilities(x, y, use)
    assert sorted(at.tolist()) == np.flatnonzero(use).tolist()
    assert np.allclose(lp, plain_log_probabilities(model, x, y).ravel()[at], atol=1e-4)


def test_attention_probabilities_sum_to_one():
    model, rng = small_model(60)
    x = np.repeat(rng.integers(0, 60, (1, attention.WINDOW)), 60, axis=0)
    y = np.repeat(np.arange(60)[:, None], attention.WINDOW, axis=1)
    at, lp = model.log_probabilities(x, y, np.ones(x.shape, bool))
    assert np.allclose(np.bincount(at % attention.WINDOW, np.exp(lp)), 1, atol=1e-4)


def test_attention_gradients():
    model, rng = small_model()
    x, y = rng.integers(0, 90, (3, attention.WINDOW)), rng.integers(0, 90, (3, attention.WINDOW))
    use = rng.random(x.shape) < 0.8
    grads = {k: np.zeros_like(v) for k, v in model.p.items()}
    for name, at, g in model.gradients(x, y, use):
        grads[name][at] += g
    loss = lambda: -plain_log_probabilities(model, x, y)[use].sum()
    for k, g in grads.items():
        flat, slopes = model.p[k].reshape(-1), g.reshape(-1)
        for i in [*np.argsort(-np.abs(slopes))[:3], *rng.integers(0, flat.size, 2)]:
            old, step = flat[i], 1e-4
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2 / step - slopes[i]) < 2e-3 + 0.02 * abs(slopes[i]), k


def test_attention_is_causal_and_windows_count_once():
    model, rng = small_model()
    n = attention.WINDOW
    x = rng.integers(0, 90, (1, n))
    other = x.copy()
    half = n // 2
    other[0, half:] = (x[0, half:] + 1) % 90
    use = np.ones(x.shape, bool)
    a, b = (np.zeros(n), np.zeros(n))
    for held, inputs in ((a, x), (b, other)):
        at, lp = model.log_probabilities(inputs, x, use)
        held[at] = lp
    assert np.allclose(a[:half], b[:half], atol=1e-5) and not np.allclose(a[half:], b[half:], atol=1e-5)
    lengths = np.array([1, 5, n, n + 1, 200])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.zeros(bounds[-1], np.int32)
    for stride, fresh in ((n, 0), (n - attention.OVERLAP, attention.OVERLAP)):
        start, end, opens = attention.windows(bounds, stride)
        _, _, use, at = attention.window_ids(ids, ids, start, end)
        once = use & ((np.arange(n) >= fresh) | opens[:, None])
        assert (np.bincount(at[once], minlength=bounds[-1]) == 1).all()


def test_every_window_trains(spark, monkeypatch):
    """Each text alone holds one of 40 ids; after all rounds every id's row has been learnt from."""
    texts = [(i, np.full(attention.WINDOW * 2, 2 * i, np.uint16).tobytes()) for i in range(40)]
    tokens = spark.createDataFrame(texts, "rid long, ids binary").repartition(3)
    rank = np.full(language_model.IDS, 41, np.int32)
    rank[0:80:2], rank[language_model.END] = np.arange(40), 40
    shares = np.full(42, 1 / 42)
    before, after = attention.Attention(shares), language_model.trained(tokens, shares, rank)
    assert (np.abs(after.p["table"] - before.p["table"]).max(axis=1) > 0)[:41].all()
    assert np.array_equal(after.p["table"][41], before.p["table"][41])  # nothing taught the rest


def test_block_sums(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 3)
    rng = np.random.default_rng(3)
    values, weights = rng.normal(size=(9, 5)), rng.integers(1, 9, 9).astype(float)
    rows = [tuple(r.values()) for i, (v, w) in enumerate(zip(values, weights)) for r in common.blocks_of(v, w, i).to_pylist()]
    parts = spark.createDataFrame(rows, common.BLOCKS).repartition(7)
    weight, total = common.block_sums(parts)
    assert weight == weights.sum() and np.allclose(total, values.sum(axis=0))
    assert common.block_sums(parts.limit(0)) is None


@pytest.fixture(scope="module")
def lm_rows(docs):
    return language_model.lm_scores(docs).collect()


def test_lm_base_against_brute_force(lm_rows, table):
    words = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in table]
    counts = Counter(w for i, ws in words if crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in words)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_rows)
    assert got == want and all(r.score <= 0 and math.isfinite(r.score) for r in lm_rows)


@pytest.mark.parametrize("name, value", [("HEAD", 8), ("SLOTS", 4), ("MERGE_AT", 10), ("PIECE_BYTES", 64)])
def test_lm_base_does_not_depend_on_tables_and_pieces(docs, lm_rows, monkeypatch, name, value):
    monkeypatch.setattr(language_model, name, value)
    want = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in language_model.lm_scores(docs).collect())
    assert got == want


def test_lm_cuts_long_texts(spark, docs, lm_rows, monkeypatch):
    """A text that is encoded in pieces has the same ids."""
    texts = [" ".join(f"w{i * j % 997}" for j in range(3000)) + " \n" * (i % 3) for i in range(5)] + [None, "", "x" * 40_000]
    frame = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").coalesce(1)
    whole = {r.doc_id: r.ids for r in language_model.encoded(frame).collect()}
    parts = [len(list(slices(pa.array([t]), 1000, split=True))) for t in texts]
    assert parts[0] > 5 and parts[-1] == 1
    assert b"".join(p.data.tobytes() for p in slices(pa.array([texts[0]]), 1000, split=True)).decode() == texts[0]
    monkeypatch.setattr(language_model, "slices", lambda column, split: slices(column, 1000, split))
    encoder, got = subwords.multi_subwords(), {}
    for i, t in enumerate(texts):
        ids = [k for w in WORD.findall(t or "") for k in encoder.encoding.encode_ordinary(" " + w)]
        got[i] = np.array(ids, np.uint16).tobytes()
    assert got == {i: bytes(b) for i, b in whole.items()}


def test_lm_empty(empty):
    assert language_model.lm_scores(empty).count() == 0


def test_lm_prefers_language_to_noise_and_needs_attention(spark, sf):
    """Shuffled words are less likely than the texts themselves, and without attention held-out texts are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400")
    tokens = language_model.encoded(docs.select("doc_id", "text", (F.col("doc_id") % 5 > 0).alias("learn")))
    counts = language_model.counts_of(tokens.where("learn")).where("is_id").orderBy(F.col("n").desc(), "key").toPandas()
    rank = np.full(language_model.IDS, len(counts), np.int32)
    rank[counts.key.to_numpy(np.int64)] = np.arange(len(counts))
    shares = np.append(counts.n.to_numpy(float), 0) + 0.5
    model = language_model.trained(tokens.where("learn"), shares / shares.sum(), rank)
    rng, rows = np.random.default_rng(5), [np.frombuffer(r.ids, np.uint16) for r in tokens.where("not learn").collect()]
    end = np.uint16([language_model.END])

    def score(texts):
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return language_model.text_scores(model, np.concatenate([np.concatenate([t, end]) for t in texts]), bounds, rank, 9.0)

    plain, mixed = score(rows), score([rng.permutation(r) for r in rows])
    assert plain.sum() > 0.9 * mixed.sum() and (plain > mixed).mean() > 0.9
    first = counts.n.to_numpy(float)
    unigram = sum(np.log10((first[rank[r]] if len(r) else np.zeros(0)).clip(0.5) / first.sum()).sum() for r in [r[rank[r] < len(first)] for r in rows])
    assert plain.sum() > 0.85 * unigram  # nearer to 0 by far
    model.p["table"][:, attention._value] = 0
    assert score(rows).sum() < 1.02 * plain.sum()


def test_lm_query(spark, sf):
    assert op8_lm_scores(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
