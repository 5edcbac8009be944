import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["ka", "ro", "mi", "ten", "sol", "ba", "ur", "lin", "pe", "dor", "fa", "ghi"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, with two extra columns whose names operators use themselves."""

    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = sources or [f"src{i % 3}" for i in range(len(texts))]
        rows = [(i, t, "en", s, len(t) if t else 0, "x", 1) for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, DOCS + ", fp string, size int")

    return make


@pytest.fixture(scope="session")
def save(tmp_path_factory):
    """Write named tables into a folder as the queries read them."""

    def put(**tables):
        at = str(tmp_path_factory.mktemp("sf"))
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}.parquet")
        return at

    return put
