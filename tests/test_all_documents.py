"""Queries over every document against brute force."""

import re

import duckdb

from litlake.plans import papers

FOLDER = "/root/testdata/sf0.001"


def texts():
    return duckdb.sql(f"SELECT doc_id, lang, text FROM '{FOLDER}/documents.parquet' WHERE text IS NOT NULL").fetchall()


def test_simple_sentences_of_all_documents(spark):
    want = set()
    for doc, _, text in texts():
        parts = [p for x in re.findall("[^。！？!?；;]+[。！？!?；;]?", text) if (p := x.strip())]
        want |= {(doc, n, p) for n, p in enumerate(parts)}
    got = [(r["doc_id"], r["n"], r["sentence"]) for r in papers.simple_sentences(spark, FOLDER).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {d for d, lang, _ in texts() if lang != "zh"} & {d for d, _, _ in got}
