import json

import pytest
from pyspark.sql import functions as F

from litlake import pipeline, ports
from litlake.operators import joblog
from litlake.sources import proceedings, sinks


def pair(title, link):
    return f'<dt class="ptitle"><a href="x">{title}</a></dt><dd>[<a href="{link}">pdf</a>]</dd>'


def rows(df):
    return sorted((r["title"], r["url"]) for r in df.collect())


def test_notes_in_pages(spark):
    notes = [{"id": f"n{i}", "content": {"title": {"value": f"Title\n{i}"}, "venue": {"value": "ICLR Oral" if i % 2 else ""}, "keywords": {"value": ["a", "b"]}}} for i in range(25)]
    address = "https://api2.openreview.net/notes?invitation=ICLR.cc%2F2026%2FConference%2F-%2FSubmission&limit=1000&offset="
    short = address.replace("limit=1000", "limit=10")
    pages = {f"{short}{o}": json.dumps({"count": 25, "notes": notes[o : o + 10]}).encode() for o in (0, 10, 20)}
    pages[address + "0"] = json.dumps({"count": 25, "notes": notes}).encode()
    spark.dataSource.register(proceedings.notes_source(ports.TableFetcher(pages)))
    read = spark.read.format("litlake_notes").options(venue="ICLR.cc/2026/Conference", limit="10").load()
    assert read.count() == 25 and read.rdd.getNumPartitions() == 3
    papers = proceedings.fetch_papers(spark, "ICLR", 2026, ports.TableFetcher(pages))
    assert papers.columns == proceedings.COLUMNS
    r = papers.where("paper_id = 'n3'").first()
    assert (r["title"], r["type"], r["keywords"], r["abstract"], r["url"]) == ("Title 3", "oral", "a,b", "", "https://openreview.net/pdf?id=n3")
    empty = {address + "0": b'{"count": 0, "notes": []}'}
    assert proceedings.fetch_papers(spark, "ICLR", 2026, ports.TableFetcher(empty)).count() == 0


def test_pages_of_days_and_years(spark):
    base = "https://openaccess.thecvf.com/CVPR2019?day=all"
    pages = {
        base: b'<dl><dd><a href="CVPR2019?day=1">d1</a></dd><dd><a href="/CVPR2019?day=2">d2</a></dd><dd><a href="gone">d3</a></dd><dd><a href="no">d4</a></dd></dl>',
        "https://openaccess.thecvf.com/CVPR2019?day=1": (pair("Emotion A", "a.pdf") + pair("B", "b.pdf")).encode(),
        "https://openaccess.thecvf.com/CVPR2019?day=2": pair("C &amp; D", "c.pdf").encode(),
        "https://openaccess.thecvf.com/CVPR2024?day=all": pair("E", "e.pdf").encode(),
        "https://www.ecva.net/papers.php": (
            '<button class="accordion">ECCV 2024 Papers</button>' + pair("F", "f.pdf") + '<button class="accordion">ECCV 2022 Papers</button>' + pair("G", "g.pdf") + pair("H", "h.pdf")
        ).encode(),
    }
    fetcher = ports.TableFetcher(pages)
    old = proceedings.fetch_papers(spark, "CVPR", 2019, fetcher, patterns=["Emo", "B"])
    assert rows(old) == [("B", "b.pdf"), ("C & D", "c.pdf"), ("Emotion A", "a.pdf")]
    assert {r["title"]: (r["keywords"], r["type"]) for r in old.collect()}["Emotion A"] == ("Emo", "CVPR")
    assert rows(proceedings.fetch_papers(spark, "cvpr", 2024, fetcher)) == [("E", "e.pdf")]
    assert rows(proceedings.fetch_papers(spark, "ECCV", 2022, fetcher)) == [("G", "g.pdf"), ("H", "h.pdf")]
    assert rows(proceedings.fetch_papers(spark, "ECCV", 2018, fetcher)) == []
    with pytest.raises(ValueError):
        proceedings.fetch_papers(spark, "SIGXYZ", 2020, fetcher, "openaccess")


def entry(title, link):
    return f'<li class="entry inproceedings"><nav><div class="head"><a href="{link}"></a></div></nav><span class="title">{title}</span></li>'


def test_links_behind_links(spark):
    page = f'<ul class="publ-list">{entry("Preface", "https://dl.acm.org/x")}</ul><ul class="publ-list">{entry("A.", "https://ojs/view/1")}{entry("B.", "https://ojs/view/2")}{entry("C.", "https://gone")}</ul>'
    pages = {
        "https://dblp.uni-trier.de/db/conf/aaai/aaai2022.html": page.encode(),
        "https://ojs/view/1": b'<a class="obj_galley_link pdf" href="1/10">PDF</a>',
        "https://ojs/view/2": b'<a href="/down/2" class="obj_galley_link pdf">PDF</a>',
    }
    assert rows(proceedings.fetch_papers(spark, "AAAI", 2022, ports.TableFetcher(pages))) == [("A.", "https://ojs/view/1/10"), ("B.", "https://ojs/down/2")]
    html = spark.createDataFrame([("u", page)], "url string, html string")
    assert [r["section"] for r in proceedings.list_sections(html).collect()] == [0, 1] and proceedings.list_sections(html, [1, 9]).count() == 1


def test_resolved_addresses(spark):
    cases = [("http://a/b/c", "d", "http://a/b/d"), ("http://a/b/c", "/d", "http://a/d"), ("http://a/b/c", "../d", "http://a/d"), ("http://a/b", "//h/d", "http://h/d"), ("http://a/b", "https://x/y", "https://x/y"), (None, None, None)]
    df = spark.createDataFrame(cases, "b string, r string, want string")
    assert df.where(~proceedings.resolve_url(F.col("b"), F.col("r")).eqNullSafe(F.col("want"))).count() == 0


def test_files_and_all_stages(spark, tmp_path):
    contents = spark.createDataFrame([("a.pdf", bytearray(b"1")), ("b/c.pdf", bytearray(b"22")), ("d.pdf", None)], "file string, content binary")
    assert sorted(map(tuple, sinks.write_files(contents, str(tmp_path / "pdfs")).collect())) == [("a.pdf", 1), ("b/c.pdf", 2)]
    assert sorted(p.name for p in (tmp_path / "pdfs").iterdir()) == ["a.pdf", "c.pdf"]
    pages = {"https://openaccess.thecvf.com/ICCV2023?day=all": (pair("Emotion A", "http://x/a.pdf") + pair("Other", "http://x/o.pdf")).encode(), "http://x/a.pdf": b"# T\n\ntext"}

    def parse(contents):
        return contents.select(F.regexp_replace("file", ".pdf$", "").alias("stem"), F.col("file").alias("pdf_path"), F.decode("content", "UTF-8").alias("full_text"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("string").alias("year"))

    status, summaries, reports = pipeline.run_stages(spark, "ICCV", 2023, ["emotion"], ports.TableFetcher(pages), parse, ports.HashCompleter())
    assert [(r["title"], r["download_status"], r["parse_status"], r["report_status"]) for r in status.collect()] == [("Emotion A", "downloaded", "parsed", "done")]
    assert summaries.count() == 1 and [r["venue"] for r in reports.collect()] == ["ICCV"]
    sinks.write_markdown(summaries, str(tmp_path / "md"), "stem", "summary")
    assert [p.name for p in (tmp_path / "md").iterdir()] == ["2023_ICCV_Emotion A.md"]


def test_job_lifecycle(spark):
    events = [("a", 1, "queued", 2), ("a", 2, "start", 2), ("a", 3, "exit0", 2), ("a", 4, "start", 2), ("a", 5, "error", 2), ("a", 6, "exit1", 2), ("b", 1, "start", 1), ("b", 2, "exit0", 1), ("c", 1, "start", 3), ("c", 2, "cancel", 3), ("c", 3, "exit0", 3)]
    df = spark.createDataFrame(events, "job string, seq int, event string, total int")
    got = {(r["job"], r["seq"]): (r["status"], r["current_index"], r["completed"], r["failed_files"], r["exit_code"]) for r in joblog.job_states(df, "job", ["seq"], "event", "total").collect()}
    assert [got["a", i][0] for i in range(1, 7)] == ["queued", "running", "running", "running", "running", "failed"]
    assert got["a", 6] == ("failed", 2, 1, 2, 1) and got["b", 2] == ("completed", 1, 1, 0, 0) and got["c", 3][0] == "canceled"


def test_steps_on_the_command_line(spark, tmp_path, monkeypatch):
    import types

    module = types.ModuleType("stand_ins")
    pages = {"https://openaccess.thecvf.com/ICCV2023?day=all": (pair("Emotion A", "http://x/a.pdf") + pair("Other", "http://x/o.pdf")).encode(), "http://x/a.pdf": b"# T\n\ntext"}
    module.fetcher = lambda: ports.TableFetcher(pages)
    module.completer = ports.HashCompleter
    module.parser = lambda: lambda c: c.select(F.regexp_replace("file", ".pdf$", "").alias("stem"), F.col("file").alias("pdf_path"), F.decode("content", "UTF-8").alias("full_text"), F.lit("").alias("venue"), F.lit("").alias("year"))
    monkeypatch.setitem(__import__("sys").modules, "stand_ins", module)
    common = ["--fetcher", "stand_ins:fetcher"]
    papers, kept, status = (str(tmp_path / n) for n in ("ICCV2023_papers.csv", "ICCV2023_kept.csv", "status.xlsx"))
    pipeline.main(["fetch", "--conference", "ICCV", "--year", "2023", "--output", papers, *common])
    pipeline.main(["filter", "--input", papers, "--output", kept, "--keywords", "emotion"])
    pipeline.main(["download", "--input", kept, "--output", status, "--folder", str(tmp_path / "pdfs"), *common])
    assert [p.name for p in (tmp_path / "pdfs").iterdir()] == ["2023_ICCV_Emotion A.pdf"]
    parsed = str(tmp_path / "parsed.parquet")
    spark.createDataFrame([("2023_ICCV_Emotion A", "# T\n\ntext")], "stem string, full_text string").write.parquet(parsed)
    pipeline.main(["summarize", "--input", parsed, "--output", str(tmp_path / "s.parquet"), "--folder", str(tmp_path / "md"), "--completer", "stand_ins:completer"])
    assert [p.name for p in (tmp_path / "md").iterdir()] == ["2023_ICCV_Emotion A.md"]
    pipeline.main(["run", "--conference", "ICCV", "--year", "2023", "--keywords", "emotion", "--parser", "stand_ins:parser", "--completer", "stand_ins:completer", "--output", str(tmp_path / "all"), *common])
    assert spark.read.parquet(str(tmp_path / "all/reports.parquet")).count() == 1 and spark.read.parquet(str(tmp_path / "all/status.parquet")).first()["report_status"] == "done"
