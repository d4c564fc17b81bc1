import duckdb
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, ties, repeated rows, clashing extra columns, and empty and odd texts."""
    texts = [None, "", " \n\t", "one", "One two", "one  two", "the same words in a row here", "The same words in\na row here", "é ü ß ▁ 你好 \U0001f600 </s>", "x" * 5000, "a\x0bb\x0cc\rd", "+1 (415) 555-0123 mail a.b@c.de 4111 1111 1111 1111 10.0.0.256 10.0.0.1", "12 34", None, "one"]
    rows = [(i if i != 4 else None, t, "en" if i % 3 else None, "s" if i % 2 else None, i, "extra") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (6, "one", "de", "t", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, NODE string")
