import pytest

#: Columns that could clash with names inside the operators.
CLASHING = ("_id", "_rest", "_digit", "_text", "id", "text2", "_lines", "_host", "score", "key", "shard", "_gone", "n_pieces_", "kept")


@pytest.fixture
def odd(spark):
    """Null and empty texts, ties, repeated rows, a very long text, and columns with clashing names."""
    long = "word" + " lorem ipsum dolor" * 20_000
    rows = [(1, "same text here now", "a"), (2, "same text here now", "a"), (2, "same text here now", "a"), (3, None, None), (4, "", "b"), (5, long, "b"), (6, long, "b"), (7, "   \n\n ", "b"), (None, "no id at all here", "a"), (8, "Ünï ▁ çode 😀 text", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASHING})
