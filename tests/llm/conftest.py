import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents of texts, or of whole rows; columns with clashing names beside those of documents."""

    def make(texts, clash=False):
        rows = [t if isinstance(t, tuple) else (i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA)
        if clash:
            for name in ("__row", "__key", "__fp", "row", "key", "hit", "seed", "shard", "slot", "rest", "times", "before", "needed", "t", "s", "h", "x", "y", "id", "score", "class"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make


@pytest.fixture(scope="session")
def rows_equal():
    def check(df, columns, want):
        got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
        assert got == sorted(map(repr, want))

    return check
