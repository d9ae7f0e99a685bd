"""Small tables for the text operators."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(None, "a row without an id", "en", "s", 1), (900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n\t\n", "en", "s", 4), (903, "word", "en", None, 4), (904, "long word " * 4000, "en", "s", 40000)]


def table(spark, rows, parts=3):
    """Rows of (doc_id, text) or of all columns, with more columns whose names the operators use themselves."""
    full = [(*r, "en", "s", len(r[1] or "")) if len(r) == 2 else r for r in rows]
    d = spark.createDataFrame(full, SCHEMA).repartition(parts)
    return d.selectExpr("*", "'x' AS h", "1 AS part", "'y' AS block", "2 AS n_words", "3 AS label")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
