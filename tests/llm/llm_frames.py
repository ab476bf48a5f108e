import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece string"


def docs_of(spark, texts, ids=None):
    """Documents with the given texts and a column whose name clashes with an operator's own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in zip(ids, texts)], DOCS)
