import json
import zipfile

import pytest

from litlake import ports
from litlake.sources import files, sinks
from litlake.streaming import streams


def write_xlsx(path, rows):
    cells = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>"
        for i, r in enumerate(rows, 1)
    )
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml" Type="t"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿title,x\n"a, ""b""\nc",nan\n,2\n', encoding="utf-8")
    rows = files.read_table(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [('a, "b"\nc', None), (None, "2")]
    write_xlsx(tmp_path / "b.XLSX", [("title", "y"), ("t", None), (None, "NA")])
    df = files.read_table(spark, str(tmp_path / "b.XLSX"), "S")
    assert df.columns == ["title", "y"] and [tuple(r) for r in df.collect()] == [("t", None), (None, None)]
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xls")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b', None), ("c\nd", "e")], "x string, y string")
    for kind in ("csv", "json", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        sinks.write_table(df, path)
        assert sorted(map(repr, files.read_table(spark, path).select("x", "y").collect())) == sorted(map(repr, df.collect()))


def test_workbook_round_trip(spark, tmp_path):
    from litlake.sources import sinks

    rows = [("a\x01b\r\n\tc", " x "), ("_x0041_ & <i>", None), ("情感😀", "NA"), (None, None)] + [(f"r{i}", "y") for i in range(30)]
    df = spark.createDataFrame(rows, "first string, `second one` string").repartition(3)
    path = str(tmp_path / "new" / "t.xlsx")
    sinks.write_table(df, path)
    back = files.read_table(spark, path)
    want = {(a, None if b == "NA" else b) for a, b in rows}
    assert back.columns == df.columns and {tuple(r) for r in back.collect()} == want and back.count() == len(rows)
    sinks.write_table(df.limit(0), path)
    assert files.read_table(spark, path).columns == df.columns and files.read_table(spark, path).count() == 0
    with pytest.raises(Exception, match="characters"):
        sinks.write_table(spark.createDataFrame([("x" * 40_000,)], "v string"), path)


def test_large_workbook_stays_off_the_driver(spark, tmp_path):
    import tracemalloc

    path = str(tmp_path / "a %20[b]{c}" / "t.xlsx")
    df = spark.range(4000).selectExpr("cast(id as string) as n", "concat(sha2(cast(id as string), 512), repeat('x', 2000)) as v")
    sinks.write_table(df, path)
    folder = str(tmp_path / "a *")
    for read in (lambda: files.read_table(spark, f"{folder}/t.xlsx"), lambda: sum(1 for _ in files._sheet_rows(path, 0))):
        tracemalloc.start()
        try:
            back = read()
            assert tracemalloc.get_traced_memory()[1] < 2_000_000  # the sheet has 8 MB
        finally:
            tracemalloc.stop()
    assert back == 4001
    assert sorted(files.read_table(spark, f"{folder}/t.xlsx").collect()) == sorted(df.collect())


def test_workbook_parts(tmp_path):
    path = tmp_path / "t.xlsx"
    write_xlsx(tmp_path / "other.xlsx", [])
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = ["b", "a", "c_x0041_"]
    links = "<hyperlinks><row><c><v>no row</v></c></row></hyperlinks>"
    with zipfile.ZipFile(path, "w") as z, zipfile.ZipFile(tmp_path / "other.xlsx") as other:
        for part in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            z.writestr(part, other.read(part))
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")
        cells = '<row r="1"><c r="A1" t="s"><v>2</v></c><c r="C1" t="s"><v>0</v></c></row><row r="2"/><row r="4"><c r="AB4"><v>1.5</v></c><c r="B4" t="s"><v>1</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><cols><col/></cols><sheetData>{cells}</sheetData>{links}</worksheet>")
    rows = [["cA", None, "b"], [], [None, "a", *[None] * 25, "1.5"]]
    assert list(files._sheet_rows(str(path), 0)) == list(files._sheet_rows(path.read_bytes(), "S")) == rows
    assert [len(b) for b in files._blocks(iter([["x" * 3_000_000], [], ["y" * 1_000_000, "z"], [None]]), 1)] == [3, 1]
    assert list(files._blocks(iter([["a", "b"], []]), 1)) == [[["a"], [None]]] and list(files._blocks(iter([]), 3)) == []


def test_listing(spark, tmp_path):
    for name in ("b.pdf", "a.PDF", "c.txt", "sub/d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda df: [r[0].rsplit("/", 1)[1] for r in df.collect()]
    assert names(files.list_files(spark, str(tmp_path))) == ["a.PDF", "b.pdf"]
    assert names(files.list_files(spark, str(tmp_path), limit=1)) == ["a.PDF"]
    assert sorted(names(files.list_files(spark, str(tmp_path), recursive=True))) == ["a.PDF", "b.pdf", "d.pdf"]


def test_column_detection(spark):
    df = spark.createDataFrame([(1, 2)], "`Paper Title` int, pdf_url int")
    assert files.detect_column(df, "title", ["papertitle"]) == "Paper Title"
    assert files.detect_column(df, "url", ["link", "url"]) == "pdf_url"
    with pytest.raises(KeyError):
        files.detect_column(df, "x", ["y"])


def test_reports_and_blocks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "tags": ["x"]}))
    (tmp_path / "paper.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{oops")
    assert [r["id"] for r in files.read_reports(spark, str(tmp_path)).collect()] == ["a"]
    path = tmp_path / "x_content_list.json"
    path.write_text(json.dumps([{"type": "image", "img_path": "i.png", "image_caption": ["a", "b"], "page_idx": 0}, {"type": "table", "table_caption": "t", "page_idx": "x"}]))
    rows = files.read_blocks(spark, str(path)).orderBy("pos").collect()
    assert [(r["path"], r["caption"], r["page_idx"]) for r in rows] == [("i.png", "a b", 0), (None, "t", None)]


def test_pages_and_notes(spark):
    html = '<dt class="ptitle"><a>T &amp; 1</a></dt><a href="1.pdf">pdf</a><dt class="ptitle">T2</dt><a href="2.pdf">PDF</a>'
    df = spark.createDataFrame([("u", html)], "url string, html string")
    assert [tuple(r) for r in files.page_pairs(df).collect()] == [("u", 0, "T & 1", "1.pdf"), ("u", 1, "T2", "2.pdf")]
    with pytest.raises(Exception, match="differ in number"):
        files.page_pairs(spark.createDataFrame([("u", html + '<dt class="ptitle">x</dt>')], "url string, html string")).collect()
    entry = '<li class="entry inproceedings"><div class="head"><a href="{}"></a></div><span class="title">T.</span></li>'
    page = spark.createDataFrame([("u", entry.format("http://a/1") + entry.format("https://dl.acm.org/x"))], "url string, html string")
    assert [r["link"] for r in files.proceedings_entries(page).collect()] == ["http://a/1"]
    notes = spark.createDataFrame([("q", (("a\nb",), None, ("ICLR Oral",), (["k", "l"],)))], "id string, content struct<title:struct<value:string>,abstract:struct<value:string>,venue:struct<value:string>,keywords:struct<value:array<string>>>")
    assert tuple(files.venue_notes(notes).first()) == ("q", "a b", "oral", "k,l", "", "https://openreview.net/pdf?id=q")


def test_rows_and_choices(spark, tmp_path):
    pairs = spark.createDataFrame([("b", 0, "t3", "l3"), ("a", 1, "t2", "l2"), ("a", 0, "t1", "l1")], "url string, pos int, title string, link string")
    assert sorted(tuple(r) for r in files.paper_rows(pairs).select("paper_id", "title", "url").collect()) == [("1", "t1", "l1"), ("2", "t2", "l2"), ("3", "t3", "l3")]
    listing = spark.createDataFrame([("d/b_content_list.json",), ("d/a_content_list.json",), ("d/a_content_list_v2.json",), ("e/x_content_list_v2.json",), ("f/y.json",)], "path string")
    assert sorted(map(tuple, files.block_files(listing).collect())) == [("d", "d/a_content_list.json"), ("e", "e/x_content_list_v2.json")]
    times = spark.createDataFrame([("k", "p1", 1), ("k", "p2", 3), ("m", "p3", 2)], "k string, path string, modificationTime long")
    assert sorted(map(tuple, files.latest_files(times, "k").collect())) == [("k", "p2"), ("m", "p3")]
    (tmp_path / "ICLR2025_x.csv").write_text("title\nA\n")
    (tmp_path / "other.csv").write_text("title\nB\n")
    assert [tuple(r) for r in files.tables_named(spark, str(tmp_path), "iclr2025").collect()] == [("A", "ICLR2025_x.csv")]
    with pytest.raises(FileNotFoundError):
        files.tables_named(spark, str(tmp_path), "cvpr2020")


def test_new_files_once(spark, tmp_path):
    schema = "id int"
    spark.range(3).selectExpr("cast(id as int) id").write.parquet(str(tmp_path / "in"))

    def run():
        q = streams.process_new_files(spark, str(tmp_path / "in"), schema, lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 3 and run() == 3
    spark.range(2).selectExpr("cast(id as int) id").write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 5


def test_log_windows_stream_and_batch(spark, tmp_path):
    rows = [("j", "2024-01-01 00:10:00", "s", "a"), ("j", "2024-01-01 00:10:00", "s", "a"), ("j", "2024-01-01 00:20:00", None, "b"), ("k", "2024-01-01 05:00:00", "s", "c")]
    log = spark.createDataFrame(rows, "job_id string, t string, stream string, message string").selectExpr("job_id", "cast(t as timestamp) logged_at", "stream", "message")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = streams.log_windows(stream).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["job_id"], r["stream"] or "", r["lines"]) for r in spark.table("w").collect())
    assert got == [("j", "", 1), ("j", "s", 1)]  # the last window is still open
    assert streams.batch_windows(log).count() == 3
    assert {(r["job_id"], r["stage"]) for r in streams.last_state(log).collect()} == {("j", "queued"), ("k", "queued")}


class Flaky:
    def __init__(self, failures):
        self.failures = failures

    def complete(self, prompt):
        self.failures -= 1
        if self.failures >= 0:
            raise OSError("no")
        return prompt.upper()


def test_retries_and_polling():
    waits = []
    assert ports.Retrying(Flaky(2), 2, sleep=waits.append).complete("a") == "A" and waits == [1.5, 3.0]
    with pytest.raises(OSError):
        ports.Retrying(Flaky(3), 2, sleep=waits.append).complete("a")
    states = iter(["running", "Done"])
    assert ports.poll(lambda: next(states), 9, 1, sleep=waits.append) == "done"
    with pytest.raises(RuntimeError):
        ports.poll(lambda: "FAILED", 9, 1)
    clock = iter(range(99))
    with pytest.raises(TimeoutError):
        ports.poll(lambda: "running", 3, 1, clock=lambda: next(clock), sleep=waits.append)


def test_summaries_keep_errors(spark):
    class Broken:
        def complete(self, prompt):
            if "bad" in prompt:
                raise ValueError("bad prompt")
            return "ok"

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "x\n\n" + "y" * 2500), (4, None)], "k int, t string")
    out = {r["k"]: (r["summary"], r["parts"], r["error"]) for r in ports.summarize(df, "k", "t", Broken(), 1000).collect()}
    assert out[1] == ("ok", 1, None) and out[2] == (None, 1, "ValueError: bad prompt") and out[3][:2] == ("ok", 4) and 4 not in out
    fetched = ports.fetch_all(spark.createDataFrame([(1, "a"), (2, "b")], "k int, u string"), "k", "u", ports.TableFetcher({"a": b"1"}))
    assert sorted((r["k"], r["content"], r["error"]) for r in fetched.collect()) == [(1, b"1", None), (2, None, "KeyError: 'b'")]


def test_summaries_by_brute_force(spark):
    """Each chunk one call, the answers in order one more; the stand-in answers with the prompt's SHA-1."""
    import hashlib

    sha1 = lambda x: hashlib.sha1(x.encode()).hexdigest()
    a, b, c, zh = "a" * 900, "b" * 700, "c" * 200, "中文。" * 300
    chunks = {1: ["short"], 2: [a], 3: [a, b + "\n\n" + c], 4: [zh, zh, "# H\n" + b], 5: [a, a, a]}
    df = spark.createDataFrame([(k, "\n\n".join(v)) for k, v in chunks.items()] + [(6, ""), (7, None)], "k int, t string")
    want = {}
    for k, parts in chunks.items():
        answers = [sha1(p) for p in parts]
        want[k] = (answers[0] if len(answers) == 1 else sha1("\n\n".join(f"### {i + 1}\n{x}" for i, x in enumerate(answers))), len(answers))
    assert {r["k"]: (r["summary"], r["parts"]) for r in ports.summarize(df, "k", "t", ports.HashCompleter(), 1000).collect()} == want
