import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int, key string, size string, row int"


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and very long texts, repeated rows, ties."""
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:120]) + "."
    rows = [(1, base), (2, base), (2, base), (3, base.replace("w60", "x60")), (4, None), (5, ""), (6, " \n\t "),
            (7, "one two"), (8, "one two"), (None, base), (None, None), (9, " ".join(words * 60)),
            (10, "Ünï " * 90), (11, "a" * 900), (12, "# $ % " * 40), (13, " ".join(words[200:320]) + ".")]
    return [(i, t, None if n % 3 else "en", None if n % 4 == 0 else f"s{n % 2}", len(t) if t else None, n, "k", "z", n)
            for n, (i, t) in enumerate(rows)]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").persist()


@pytest.fixture(scope="session")
def rows_of(documents):
    return [(r["doc_id"], r["text"], r["source"]) for r in documents.select("doc_id", "text", "source").collect()]


