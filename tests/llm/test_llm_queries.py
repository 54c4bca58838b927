"""The problems' queries over the smallest tables."""

import itertools

import duckdb
import pytest

from litlake.llm import queries, termcounts
from litlake.plans.packed import p2_found

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.count() >= 0 and not [c for c, k in df.dtypes if k == "void"]


COLUMNS = {
    "p1_found": [("stem", "string"), ("page_no", "int"), ("para_no", "int")],
    "p3_found": [("paper_id_a", "string"), ("paper_id_b", "string")],
    "p4_found": [("field", "string"), ("term", "string"), ("mark", "string")],
    "p5_found": [("field", "string"), ("stem", "string"), ("item_no", "int"), ("line_no", "int"), ("noise", "string")],
    "p6_found": [("paper_id_a", "string"), ("paper_id_b", "string")],
    "p9_found": [("doc_id", "bigint"), ("sent_end", "bigint")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns_and_distinct_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.dtypes == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and not any(x is None for r in rows for x in r)


def test_pairs_by_brute_force(spark):
    con = duckdb.connect()
    place = dict(con.sql(f"SELECT pos, paper_id FROM '{FOLDER}/all_papers.parquet'").fetchall())
    sets: dict[str, set[str]] = {}
    for r in p2_found(spark, FOLDER).where("field = 'keywords'").collect():
        sets.setdefault(place[r["pos"]], set()).add(r["item"])
    kept = sorted(k for k, v in sets.items() if len(v) >= 3)
    want = {(a, b) for a, b in itertools.combinations(kept, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {tuple(r) for r in queries.p3_found(spark, FOLDER).collect()} == want
    texts = con.sql(f"SELECT DISTINCT ON (paper_id) paper_id, title, abstract FROM '{FOLDER}/all_papers.parquet' WHERE title <> '' AND abstract <> ''").fetchall()
    bags = {p: set(termcounts.words(f"{t} {a}")) for p, t, a in texts}
    want = {(a, b) for a, b in itertools.combinations(sorted(bags), 2) if len(bags[a] & bags[b]) / len(bags[a] | bags[b]) >= 0.7}
    assert {tuple(r) for r in queries.p6_found(spark, FOLDER).collect()} == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    import os

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
