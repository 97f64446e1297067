"""Documents that every operator is held against."""

DOCS = "doc_id long, text string, source string, ids string, spans string, hash int"


def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns whose names clash."""
    long = "lorem ipsum dolor " * 9000 + "x" * 70_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "same text of a few words"), (6, "same text of a few words"), (6, "same text of a few words"), (None, "no id"), (None, None), (7, long), (8, "é ß     日本語 😀 don't 123 'LL"), (9, "\x00 nul \x1c sep \x85 nel")]
    return spark.createDataFrame([(i, t, None if k % 3 else "s", "x", "y", k) for k, (i, t) in enumerate(rows)], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def write(spark, d, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{d}/{name}.parquet")
    return str(d)
