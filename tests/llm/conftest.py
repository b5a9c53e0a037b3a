import pytest


@pytest.fixture
def rows(spark):
    """A table of documents with every column, from (doc_id, text[, source]) tuples."""
    def make(*given, more=None):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in given]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "1 AS fp", "2 AS keys", "3 AS id", "4 AS size") if more else df
    return make
