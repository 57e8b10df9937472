import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""
    def make(pairs, lang="en", source="src0"):
        rows = [(i, t, lang, source, len(t) if t else 0, 1, "x") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", id int, key string").coalesce(2)

    return make


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


#: Null and empty texts, blanks only, a null id, repeated rows, ties and one long text without any separator.
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "x" * 200_000), (7, "é ü\nñ")]
