import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, kept boolean, shard int, score double, host string, component_id long"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(12_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, an equal doc_id, and columns whose names operators use too."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today"), (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
        (3, None), (4, ""), (5, " \t\n "), (6, LONG), (7, LONG + " tail"), (8, "one"), (8, "one"), (8, "another text of the same id"),
        (None, "no id at all here"), (None, None), (9, "naïve café — 日本語 🙂 <|endoftext|> don't\n\nline\nline\nline"), (10, "İstanbul ΣΑΣ ﬁ\u0085x\u00a0y"), (11, "NUL \x00 and \x1c sep"),
    ]
    return spark.createDataFrame([(i, t, None, None, None, 7, None, 1, 0.5, "h", 3) for i, t in rows], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def key(row, *names):
    return tuple((row[n] is None, row[n]) for n in names)
