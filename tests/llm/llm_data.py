"""Builders of small document tables."""

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, words int, h1 long, length int, piece int"


def make(spark, rows):
    """(doc_id, text, lang, source) rows with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, 7, 7, 7, 7) for i, t, lang, src in rows], SCHEMA)
