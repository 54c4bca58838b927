"""Term statistics over all documents against brute force."""

import math
import re
import unicodedata
from collections import Counter

import duckdb
import pytest

from litlake.operators import topics
from litlake.plans import documents

FOLDER = "/root/testdata/sf0.001"


def test_term_statistics_of_all_documents(spark):
    assert len(set(topics.STOP_WORDS)) == 318
    texts = duckdb.sql(f"SELECT text FROM '{FOLDER}/documents.parquet' WHERE text <> ''").fetchall()
    tf, df = Counter(), Counter()
    for (text,) in texts:
        runs = re.findall(r"[^\W_]+", "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in unicodedata.normalize("NFKC", text).lower()))
        words = [w for w in runs if len(w) > 1 and w not in topics.STOP_WORDS]
        tf.update(words)
        df.update(set(words))
    n = len(texts)
    want = {w: (tf[w], df[w], pytest.approx(math.log((1 + n) / (1 + df[w])) + 1)) for w in df if 5 <= df[w] <= 0.9 * n}
    got = {r["term"]: (r["tf"], r["df"], r["idf"]) for r in documents.term_statistics(spark, FOLDER).collect()}
    assert got == want
    assert any(not w.isascii() for w in got) and "the" not in got
