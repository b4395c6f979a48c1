import random

import pytest

WORDS = "ba ko ri mu sel tan vor pik lam neu gra zed fil hos jem".split()


@pytest.fixture
def prose():
    """Random prose: a function of (seed, number of words)."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (id, text) or (id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
