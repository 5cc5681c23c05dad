import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def rows():
    """All documents as (doc_id, text, source)."""
    return duckdb.connect().execute(f"SELECT doc_id, text, source FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long and repeated texts, tied and null ids, and columns named like the operators' own."""
    long = " ".join(f"w{i % 997}" for i in range(30000))
    data = [
        (1, "one two three four five", None, 1), (1, "one two three four five", "b", 2), (2, None, "b", 3), (None, "", "b", 4),
        (None, "one two three four five", "", 5), (3, "   \t\n ", "a", 6), (4, long, "a", 7), (5, long + " end.", "a", None),
    ]
    return spark.createDataFrame(data, "doc_id long, text string, source string, row long").selectExpr(
        "*", "length(text) AS n_chars", "'en' AS lang", "row AS code", "row AS size", "text AS words", "row AS `_doc`"
    )


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
