from __future__ import annotations

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, size long, kept boolean, shard int, score double, digest string, pos int"

BASE = "The quick brown fox jumps over the lazy dog and then it runs away from the farm to see the sea"
LINE = "This line is certainly longer than forty characters in all."


def rows() -> list[tuple]:
    """Nulls, empty and long texts, ties, copies, near copies, repeated lines and a hot source; columns with clashing names."""
    texts: list[str | None] = [None, "", "   \n\t ", BASE, BASE.upper(), BASE + " now", BASE + " now", "Ünïcode ÄÖ text", "ÜNÏCODE äö text"]
    texts += [f"{LINE}\nown line {i} of a document\n  {LINE.upper()} \n" for i in range(7)]
    texts += [" ".join(f"w{(i * 7 + j * j) % 97}" for j in range(40 + i)) + "." for i in range(12)]
    texts += ["Der schnelle braune Fuchs springt über den faulen Hund und läuft dann weg.", "Le renard brun saute par-dessus le chien paresseux et puis il part."]
    texts += ["long " * 30_000 + "\n" + "x" * 20_000, "!!! ??? 123 \x0b\x0c", "a", "a b"]
    out = []
    for i, t in enumerate(texts):
        lang = None if i % 11 == 3 else ("en", "de", "fr")[i % 3]
        source = None if i % 9 == 4 else ("hot" if i % 3 else f"s{i % 4}")
        out.append((i + 1, t, lang, source, None, -1, -2, None, -3, None, "x", None))
    out.append((None, "a text without an id", None, None, None, None, None, None, None, None, None, None))
    out.append((4, BASE, "en", "s1", 1, 1, 1, True, 1, 1.0, "y", 1))  # repeats document 4
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SHAPE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="session")
def table() -> list[tuple]:
    return [(r[0], r[1]) for r in rows()]
