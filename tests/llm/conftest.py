import pytest


@pytest.fixture
def docs(spark):
    """documents with clashing names, null and empty texts, repeated rows and ties."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        rows = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(rows, schema)
        if extra:
            from pyspark.sql import functions as F

            for name in ("key", "n", "size", "score", "component_id", "position", "spans", "copies"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
