import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{k % 977} of{k % 31}" for k in range(20000))
    story = " ".join(f"tale{k}" for k in range(120))
    rows = [
        (1, story, "en", "a", 1), (2, story, "en", "a", 1), (2, story, "en", "a", 1), (3, story + " end", "en", None, 1),
        (4, None, None, "b", None), (5, "", "fr", "b", 0), (6, " \t\n\x0b ", None, "b", 5), (7, long, "en", "a", 9),
        (None, story, "en", "a", 1), (None, "short text", None, None, None), (8, "Été ▁ \u00a0x\0y 日本語", "fr", "c", 3),
        (9, "a" * 1500, None, "c", 2), (9, "b c d " * 200, "en", "c", 2), (10, "one two", "en", "", 2),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({
        "row": F.lit("r"), "size": F.lit(-1), "kept": F.lit("k"), "target": F.lit(None).cast("double"), "host": F.lit("h"),
        "pieces": F.lit("p"), "n_words": F.lit("n"), "_words": F.lit("w"), "node": F.lit(1), "id": F.lit(2), "score": F.lit("s"),
        "tags": F.create_map(F.lit("a"), F.lit(1)),
    })


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
