"""Small tables and brute-force versions for the training-data operators."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id string"


def docs(spark, texts, ids=None, langs=None):
    """Documents with two more columns whose names clash with ones used inside."""
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, la, "s", None, "x", "y") for i, t, la in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, DOCS)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
