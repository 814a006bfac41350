import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a table of documents from (id, text, lang, source), with a column whose name clashes with inner ones."""

    def build(rows, extra=False):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        out = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("row", "fp", "key", "kept", "spans", "size", "start", "w", "mark", "ids"):
                out = out.withColumn(name, F.lit(name))
        return out

    return build
