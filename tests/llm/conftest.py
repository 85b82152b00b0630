import pytest

EXTRA = ["id", "key", "node", "kept", "score", "size", "copy", "words", "position", "print", "item_ids", "block", "_id", "_keep0", "h"]


def with_extra(df):
    """`df` with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    for name in EXTRA:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing names."""
    long = " ".join(f"word{i % 4001}" for i in range(60_000)) + "."
    rows = [
        (1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, " \n\t ", "en", "t"),
        (None, "a b c d e f g", "en", "s"), (5, long, "en", "s"), (6, long, "de", "t"), (7, "A B C D E F G", "en", "é"), (8, "one two", "en", "s"),
        (9, "ONE\ttwo", None, "s"), (1, "another text of that same number here", "en", "s"),
    ]
    return with_extra(spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
