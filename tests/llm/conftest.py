import math

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97}x{i % 31}" for i in range(3000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rows = [(1, "alpha beta gamma delta", "en", "s1", 4), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, "   \t\n ", "fr", "s2", 6), (None, "no id here at all", "fr", "s2", 1)]
    rows += [(5, LONG, "en", "s1", len(LONG))] * 2 + [(6, LONG + " tail", "en", None, 1), (7, "x" * 20000, "de", "s3", 1), (8, "12 34 !!", "de", "s3", 1)]
    rows += [(9, f"before {PASSAGE} after", "en", "s1", 1), (10, f"other start {PASSAGE} other end", "en", "s2", 1), (11, "Größe ÉTÉ naïve 日本語  x", "de", "s2", 1), (11, "<|endoftext|> a<|startoftext|>b", "de", "s2", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def sf(spark, tmp_path):
    """Writes a table where a query reads it."""

    def write(df, name="documents"):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def same(a, b):
    return a == b or isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
