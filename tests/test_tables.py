from pyspark.sql import functions as F

from litlake.operators import facets, joblog, reports, tables
from litlake.sources import sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ensure_columns_keeps_existing(spark):
    df = spark.createDataFrame([("parsed",)], "parse_status string")
    out = tables.ensure_columns(df)
    assert out.first()["parse_status"] == "parsed" and out.first()["download_status"] == "pending" and len(out.columns) == 6
    assert tables.ensure_columns(out).columns == out.columns


def test_keep_first_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("t1", "u1", 1), ("t2", "u1", 2), ("t3", None, 3), ("t4", "u2", 4), ("t5", None, 5), ("t1", "u1", 1)], "t string, u string, pos int")
    assert rows(tables.keep_first(df, ["u"], "pos").select("t")) == [("t1",), ("t3",), ("t4",)]
    assert tables.keep_first(df.limit(0), ["u"], "pos").count() == 0


def test_first_seen_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "g string, pos int")
    assert rows(tables.first_seen_order(df, "g", "pos")) == [("a", 2, 2), ("b", 1, 1), ("b", 3, 1), (None, 4, 3)]


def test_upsert_reconcile_and_lookup(spark):
    status = spark.createDataFrame([("d/a.pdf", "pending", 1), ("", "pending", 2), (None, "x", 3), ("e\\a.pdf", "old", 4)], "pdf_path string, s string, pos int")
    new = spark.createDataFrame([("z/a.pdf", "done"), ("z/a.pdf", None)], "pdf_path string, s string")
    assert rows(tables.upsert_by_file(status, new, ["s"]).select("pos", "s")) == [(1, "done"), (2, "pending"), (3, "x"), (4, "done")]
    files = spark.createDataFrame([("x/a.pdf",)], "path string")
    papers = spark.createDataFrame([("a.pdf", "", "downloaded"), ("b.pdf", "", "downloaded")], "name string, pdf_path string, download_status string")
    assert rows(tables.reconcile_files(papers, F.col("name"), files).select("pdf_path", "download_status")) == [("a.pdf", "downloaded"), ("b.pdf", "missing")]
    names = spark.createDataFrame([("a.pdf",), ("c.pdf",)], "file string")
    assert rows(tables.first_status_row(names, status, "pos").select("file", "pos")) == [("a.pdf", 1), ("c.pdf", None)]


def test_merge_and_changes(spark):
    generated = spark.createDataFrame([("k", "1", "2"), ("m", "3", None)], "id string, a string, b string")
    existing = spark.createDataFrame([("k", None, ""), ("n", "9", "9")], "id string, a string, b string")
    assert rows(tables.merge_metadata(generated, existing, "id")) == [("k", "1", ""), ("m", "3", None), ("n", "9", "9")]
    assert rows(tables.changed_rows(existing, generated, "id", ["a", "b"]).select("id")) == [("k",), ("m",)]
    assert tables.changed_rows(generated, generated, "id", ["a", "b"]).count() == 0


def test_assets(spark):
    files = spark.createDataFrame([("d", "x/i.png"), ("d", "a/i.png"), ("d", "k.png")], "doc string, path string")
    refs = spark.createDataFrame([("d", "x/i.png"), ("d", "q/i.png"), ("d", "none.png"), ("e", "k.png")], "doc string, ref string")
    assert rows(tables.resolve_assets(refs, files).select("doc", "ref", "path")) == [
        ("d", "none.png", None), ("d", "q/i.png", "a/i.png"), ("d", "x/i.png", "x/i.png"), ("e", "k.png", None)
    ]


def test_first_artefact_and_tags(spark):
    items = spark.createDataFrame([("s", "l"), ("q", "l"), (None, None)], "short string, long string")
    files = spark.createDataFrame([("l",), ("s",), ("s",)], "path string")
    assert rows(tables.first_artefact(items, ["short", "long"], files)) == [("q", "l", "l"), ("s", "l", "s"), (None, None, None)]
    df = spark.createDataFrame([(["emotion", "llm"], ["LLM", "gaze", None]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(reports.merge_tags(F.col("a"), F.col("b"))).collect()] == [["Emotion", "LLM", "Gaze"], ["A"]]


def test_ids_and_names(spark):
    df = spark.createDataFrame([("g", 1, "5"), ("g", 2, None), ("g", 3, "x"), ("g", 4, "5"), ("g", 5, "2")], "g string, pos int, id string")
    assert [r["id"] for r in tables.assign_ids(df, "id", "pos", "g").orderBy("pos").collect()] == [5, 1, 2, 3, 4]
    names = spark.createDataFrame([("g", 1, "Fig 1.PNG"), ("g", 2, "fig-1.png"), ("g", 3, None)], "g string, pos int, name string")
    assert [r["unique_name"] for r in tables.unique_names(names, "name", "pos", "g").orderBy("pos").collect()] == ["fig-1.png", "fig-1-2.png", "image"]


def test_union_and_lines(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q", 2)], "y string, x int")
    assert rows(tables.union_by_name([a, b])) == [(1, None), (2, "q")]
    df = spark.createDataFrame([(1, "t1", "u1"), (2, "t2", "u1"), (3, "t3", None), (4, "t%", "u2")], "pos int, title string, url string")
    assert rows(sinks.title_lines(df).select("line")) == [("+ t% [Paper](u2)",), ("+ t1 [Paper](u1)",)]


def test_facets(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", None, ""],), (None,)], "tags array<string>")
    assert rows(facets.tag_counts(df)) == [("a", 2), ("b", 1)]
    reports = spark.createDataFrame([("x", 2025, "B", "1"), ("y", None, "A", "2"), ("z", 2025, "A", "3")], "title string, year int, venue string, id string")
    assert [r["title"] for r in facets.top_rows(reports, 3, *facets.report_order("recent")).collect()] == ["z", "x", "y"]


def test_report_view(spark):
    schema = "pos int, id string, slug string, title string, fullTitle string, year string, category string, type string, modality string, tags array<string>, introduction string, venue string"
    df = spark.createDataFrame([(0, None, "/blog/x-1", None, "F", "2024", *[None] * 3, [" a ", ""], None, "V"), (4, *[None] * 11)], schema)
    a, b = facets.report_view(df).collect()
    assert (a["id"], a["title"], a["year"], a["tags"], a["venue"]) == ("x-1", "F", 2024, ["a"], "V")
    assert (b["id"], b["title"], b["year"], b["tags"], b["venue"], b["modality"]) == ("paper-5", "paper-5", None, [], "Unknown", "unknown")


def test_log_tail_with_hot_job(spark):
    log = spark.createDataFrame([("hot", i, "s", f"m{i}") for i in range(3000)] + [("cold", 1, None, "m"), ("cold", 1, None, "m")], "job_id string, logged_at long, stream string, message string")
    out = joblog.log_tail(log, 10)
    assert [r["message"] for r in out.where("job_id = 'hot'").orderBy("place").collect()] == [f"m{i}" for i in range(2999, 2989, -1)]
    assert out.where("job_id = 'cold'").count() == 2
