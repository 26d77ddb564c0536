import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """A maker of deterministic texts of ``n`` words."""
    syllables = ["ba", "re", "mi", "to", "nal", "ver", "ik", "son", "quel", "dra"]

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table with extra columns whose names operators use themselves."""

    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return df.withColumns({"n_chars": F.length("text").cast("long"), "id": F.lit(1), "size": F.lit("x"), "rate": F.lit(2), "fp": F.lit(3), "key": F.lit("k"), "spans": F.lit(4), "score": F.lit(5)})

    return make
