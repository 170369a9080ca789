import random

import pytest

from lakewarden.llm.shipping import ship
from lakewarden.session import fresh_path


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def work(spark):
    return fresh_path(spark, "test")


DOCS = "doc_id bigint, text string, lang string, source string, batch int, kept_0 string"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, source]); with columns whose names operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def odd_texts():
    """Null and empty texts, blanks of all kinds, marks, a very long word and a very long text."""
    words = "alpha beta gamma delta épsilon 日本 ' 's don't x.y... <|x|> naïve".split()
    chosen = random.Random(4)
    long_text = " ".join(chosen.choice(words) for _ in range(30_000))
    return [None, "", " ", "\n\t\v\f\r ", "a", "é", "a b c", "w" * 30_000, long_text,
            long_text, "A b\nA b\n\nc", "\\ ### </turn>", "🙂 ́x \x00 y"]
