from pyspark.sql import functions as F

from litlake import pipeline, ports, settings
from litlake.functions import text as t
from litlake.operators import reports, sections, visuals
from litlake.sources import files

SUMMARY = "# 题\n## 基本信息\n- 研究任务：识别视频中的细微表情和情绪\n## 核心问题\n短。这个问题关系到多模态情感识别的稳定性。\n### 细节\nx\n## 方法概述\n我们提出了一个由两部分组成的对齐框架。\n"


def test_summary_sections(one):
    assert one(t.summary_section, SUMMARY, ["核心问题"]) == "短。这个问题关系到多模态情感识别的稳定性。\n### 细节\nx"
    assert one(t.summary_section, SUMMARY, ["没有"]) == ""
    assert one(t.info_field, SUMMARY, "研究任务") == "识别视频中的细微表情和情绪"
    assert one(reports.introduction_from_summary, SUMMARY) == "这个问题关系到多模态情感识别的稳定性。 我们提出了一个由两部分组成的对齐框架。 识别视频中的细微表情和情绪"
    assert one(reports.introduction_from_summary, "## 核心问题\nonly english") == ""


def test_images_and_json(spark, one):
    paths = F.create_map(F.lit("a.png"), F.lit("img/a.png"))
    assert one(lambda c: t.rewrite_images(c, paths), "![x](a.png) [y](a.pdf) ![z](b.png) ![u](http://q/a.png)") == "![x](img/a.png) [y](a.pdf) ![z](b.png) ![u](http://q/a.png)"
    search = lambda c: t.json_search(c, ["task_id", "id"])
    assert one(search, '{"data": [{"x": {"id": 7}}, {"task_id": "t"}]}') == "7"
    assert one(search, '{"task_id": "", "data": {"task_id": {"a": 1}}}') == '{"a": 1}'
    assert one(search, "bad \"id\"") is None and one(search, None) is None and one(search, "{}") is None


def test_prompts_and_fallback(one):
    prompt = lambda c: sections.chunk_prompt("{source_name} {index}/{total}: {chunk}", F.lit("s"), c, F.lit(1), F.lit(2))
    assert one(prompt, "text {index}") == "s 1/2: text {index}"
    assert one(lambda c: sections.reduce_prompt("{merged}", c, F.array(F.lit("a"), F.lit("b"))), "s") == "### 分片 1\na\n\n### 分片 2\nb"
    out = one(lambda c: sections.fallback_report(F.lit("name"), c, F.lit("boom")), "# T\n## Abstract\nabs\n## M\nx")
    assert out.startswith("# T\n\n> boom") and "abs" in out and "- ## M" in out


def test_insert_visuals(spark):
    schema = "doc string, item_index int, kind string, path string, caption string, section string, before_text string, after_text string, table_body string"
    items = spark.createDataFrame(
        [("d", 1, "image", "p.png", "Figure 1. Overview of X", *[None] * 4), ("d", 2, "table", "q.png", "accuracy results", *[None] * 4), ("d", 3, "image", "old.png", None, *[None] * 4), ("d", 4, "image", None, "c", *[None] * 4), ("e", 1, "image", "z.png", "limitation", *[None] * 4)],
        schema,
    )
    summaries = spark.createDataFrame([("d", "# S\n## 方法概述\nm\n![o](old.png)\n## 相关图表\n## 主要结果\nr"), ("e", "plain"), ("f", "none")], "doc string, md string")
    out = {r["doc"]: r["md"] for r in visuals.insert_visuals(summaries, items, "doc", "md").collect()}
    assert out["d"].index("方法概述") < out["d"].index("p.png") < out["d"].index("主要结果") < out["d"].index("q.png") < out["d"].index("\nr")
    assert out["d"].count("old.png") == 1 and "相关图表" not in out["d"] and 'alt="Figure 1"' in out["d"]
    assert out["e"].startswith("plain\n\n## 局限与不足\n") and out["f"] == "none"


def test_settings():
    env = {"LITLAKE_MAX_CHUNKS": "3", "LITLAKE_OVERWRITE": "Yes", "LITLAKE_TOKEN": "secret"}
    s = settings.Settings.from_env(env=env)
    assert (s.max_chunks, s.overwrite, s.chunk_chars) == (3, True, 12_000) and "secret" not in repr(s)
    assert settings.first_env("A", "B", env={"A": " ", "B": "x"}) == "x"
    assert settings.canonical_query({"b": "a b*~", "a": None}) == "a=&b=a%20b%2A~"
    assert settings.signature("k", b"t") == "tUOESK7yg0lVdo3pY/6aLIzSyXTDvUnHLYFl65GwL7A=" or len(settings.signature("k", b"t")) == 44


def test_stages(spark, tmp_path):
    papers = spark.createDataFrame(
        [(1, "p1", "Emotion: A", "x", "affect", "http://a/forum?id=1"), (2, "p2", "Other", None, None, "http://a/2"), (3, "p3", "emotion B", None, None, None)],
        "pos int, paper_id string, title string, abstract string, keywords string, url string",
    )
    kept = pipeline.filter_stage(papers, ["emotion"])
    done, contents = pipeline.download_stage(kept, "ICLR", 2026, ports.TableFetcher({"http://a/pdf?id=1": b"%PDF"}))
    assert {r["pos"]: (r["pdf_path"], r["download_status"]) for r in done.collect()} == {1: ("2026_ICLR_Emotion_ A.pdf", "downloaded"), 3: ("2026_ICLR_emotion B.pdf", "missing")}
    assert contents.count() == 1
    parsed = spark.createDataFrame([("2026_ICLR_Emotion_ A", "d/2026_ICLR_Emotion_ A.pdf", "# T\n\ntext", None, None), ("s2", "d/s2.pdf", "", None, None)], "stem string, pdf_path string, full_text string, venue string, year string")
    summaries = pipeline.summary_stage(parsed, ports.HashCompleter())
    assert [r["status"] for r in summaries.collect()] == ["ok"]
    assert pipeline.summary_stage(parsed, ports.HashCompleter(), summaries.select("stem")).count() == 0
    report = pipeline.report_stage(done, parsed, summaries).collect()
    assert [(r["id"], r["year"], r["venue"]) for r in report] == [("p1", 2026, "ICLR")]

    class Failing:
        def complete(self, prompt):
            raise OSError("no quota")

    failed = pipeline.summary_stage(parsed, Failing()).first()
    assert failed["status"] == "fallback" and "no quota" in failed["summary"]


def test_command_line(spark, tmp_path):
    spark.createDataFrame([("Emotion A", "u1"), ("x", "u2"), ("Emotion B", "u1")], "title string, url string").coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    pipeline.main(["filter", "--input", str(tmp_path / "in.parquet"), "--output", str(tmp_path / "out.parquet"), "--keywords", "emotion"])
    assert files.read_table(spark, str(tmp_path / "out.parquet")).count() == 2
    pipeline.main(["export", "--input", str(tmp_path / "in.parquet"), "--output", str(tmp_path / "lines")])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["+ Emotion A [Paper](u1)", "+ x [Paper](u2)"]


def test_each_call_is_made_once(spark, tmp_path):
    class Counting:
        """Answers like the stand-in and writes down each call."""

        def __init__(self, folder):
            self.folder = str(folder)

        def _note(self, what):
            import os
            import uuid

            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(what)

        def complete(self, prompt):
            self._note(prompt)
            return prompt[:20]

        def fetch(self, url):
            self._note(url)
            return b"%PDF"

    docs = spark.createDataFrame([(i, "\n\n".join("w" * 700 for _ in range(4))) for i in range(10)] + [(99, "short")], "k int, text string")
    out = ports.summarize(docs, "k", "text", Counting(tmp_path), 1000)
    assert out.count() == 11 and {r["parts"] for r in out.collect()} == {1, 4}
    assert len(list(tmp_path.iterdir())) == 10 * 5 + 1
    (tmp_path / "f").mkdir()
    papers = spark.createDataFrame([(i, f"p{i}", f"Title {i}", f"http://a/{i}") for i in range(7)], "pos int, paper_id string, title string, url string")
    done, contents = pipeline.download_stage(pipeline.filter_stage(papers, ["title"], columns=["title"]), "ICLR", 2026, Counting(tmp_path / "f"))
    assert done.where("download_status = 'downloaded'").count() == 7 and contents.count() == 7
    assert len(list((tmp_path / "f").iterdir())) == 7
