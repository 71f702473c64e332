"""Documents with everything odd in them."""

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (None, "a text without an id"),
    (None, None),
    (7, "word"),
    (7, "word"),
    (8, "é ü " * 30 + "\U0001f600 end"),
    (9, "long " * 20_000),
    (10, "x" * 50_000),
]


def documents(spark, rows=None, clash=True):
    df = spark.createDataFrame(ODD if rows is None else rows, "doc_id long, text string")
    if clash:  # further columns, some of them named like our own
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("mine") for c in ("key", "sid", "score", "n", "block", "lang", "h", "w", "piece", "label", "text_md5")})
    return df
