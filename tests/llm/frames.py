"""Small document frames for the tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows, schema=SCHEMA):
    """Documents from (id, text) pairs or whole rows."""
    full = [row if len(row) > 2 else (*row, "en", "s", len(row[1] or "")) for row in rows]
    return spark.createDataFrame(full, schema)


def with_clashes(df, *names):
    """``df`` with extra columns of the given names."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(name) for name in names])
