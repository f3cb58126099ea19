import pytest

LONG = "word salad " * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Nulls, empties, repeats, ties, a very long text, clashing column names; read from files, as operators ask."""
    rows = [
        (1, "Hello World one two three four five six", "en"),
        (2, "hello world one two three four five six", None),
        (2, "hello world one two three four five six", None),
        (3, None, "en"),
        (4, "", "de"),
        (5, "ÄÖ straße", "de"),
        (6, "äö straße", "de"),
        (7, LONG, "en"),
        (None, "a null id", "en"),
        (None, None, None),
        (8, "  \t\n ", "fr"),
        (9, "12345 !!! ???", "fr"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("id", "body", "slot", "shard", "tag", "n", "fp", "y", "score", "kept", "group_size"):
        df = df.selectExpr("*", f"'{name}' AS {name}")
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
