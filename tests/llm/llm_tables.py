"""Tables for the tests of the training-data operators."""

from pyspark.sql import functions as F

CLASHING = ("id", "fp", "key", "band", "score", "begin", "position", "u", "at", "rep", "label")


def documents(spark, texts, lang=None):
    """Rows of documents from pairs of id and text, with columns whose names operators use inside."""
    rows = [
        (i, t, (lang or {}).get(i, "en"), f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in texts
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame(rows, schema).withColumns({name: F.lit("clash") for name in CLASHING})
