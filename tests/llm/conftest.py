import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with NULLs, empty and long texts, ties, repeated rows and clashing column names."""
    texts = [(5, "a b c d e f g. " * 30, "s1"), (4, None, None), (3, "", "s1"), (None, "no id here at all, none", "s2"), (2, "   \n ", "s2"),
             (1, "a b c d e f g. " * 30, "s1"), (1, "a b c d e f g. " * 30, "s1"), (7, "x" * 20_000 + " <|endoftext|> \x1c é日", "s3")]
    return spark.createDataFrame([(i, t, "xx", s, 0, "clash", 1) for i, t, s in texts],
                                 "doc_id long, text string, lang string, source string, size int, key string, n int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
