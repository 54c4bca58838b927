import pytest
from pyspark.sql import functions as F

from litlake.operators import figures, reports, visuals

BLOCKS = "doc_id string, pos int, type string, text string, text_level int, page_idx int, path string, caption string, table_body string"


def blocks(spark, rows):
    full = [("d", i, *r) + (None,) * (7 - len(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, BLOCKS)


def test_sections_before_visuals(spark):
    df = blocks(spark, [("image", None, None, 0, "z.png"), ("text", "Intro", 1), ("image", None, None, None, "a.png"), ("text", "2.1 Setup"), ("table", None, None, 4, "t.png")])
    out = visuals.with_context(df).where("type <> 'text'").orderBy("pos").collect()
    assert [r["section"] for r in out] == ["", "Intro", "2.1 Setup"]


def test_nearby_text_skips_short_blocks(spark):
    texts = ["x" * n for n in (70, 60, 50, 40, 10)]
    df = blocks(spark, [*(("text", x) for x in texts), ("image", None, None, 0, "a.png"), ("text", "s"), *(("text", y) for y in ("a" * 30, "b" * 31, "c" * 32, "d" * 33))])
    row = visuals.with_context(df).where("type = 'image'").first()
    assert row["before_text"] == " ".join(texts[1:4])
    assert row["after_text"] == " ".join(("a" * 30, "b" * 31, "c" * 32))
    inside = visuals.with_context(df).where("pos = 2").first()
    assert inside["before_text"] == f"{texts[0]} {texts[1]}" and inside["after_text"].startswith(texts[3] + " a")


def test_extraction(spark):
    df = blocks(spark, [("image", None, None, 0, "A.png"), ("image", None, None, None, "a.PNG"), ("image",), ("table", None, None, 2, None, "", "<tr><td>1</td></tr>"), ("image", None, None, None, "", "Figure 1")])
    out = visuals.extract_visuals(df).orderBy("item_index").collect()
    assert [(r["item_index"], r["page"], r["path"]) for r in out] == [(1, 1, "A.png"), (2, 3, None), (3, 0, "")]
    assert out[1]["table_body"] == "1 |"
    assert visuals.extract_visuals(df, most=1).count() == 1
    assert visuals.extract_visuals(df.limit(0)).count() == 0


ITEM = "doc string, item_index int, kind string, path string, caption string, section string, before_text string, after_text string, table_body string"


def test_scores_and_top(spark):
    rows = [("d", 1, "table", "p", "Table 2: Ablation results"), ("d", 2, "image", "", None), ("d", 3, "image", "q", None), ("d", 3, "image", "q", None)]
    df = spark.createDataFrame([r + (None,) * 4 for r in rows], ITEM)
    assert {r["item_index"]: r["score"] for r in visuals.top_visuals(df, "doc", 9).collect()} == {1: 14, 2: 0, 3: 0}
    assert sorted(r["item_index"] for r in visuals.top_visuals(df, "doc", 2).collect()) == [1, 3]


@pytest.mark.parametrize(
    "kind,caption,section",
    [("table", "x", "关键实验与结果"), ("table", "failure cases", "局限与不足"), ("image", "model overview", "核心方法"), ("image", "the problem", "研究问题"), ("image", None, "关键实验与结果")],
)
def test_placement_words(spark, kind, caption, section):
    df = spark.createDataFrame([("d", 1, kind, "p", caption, None, None, None, None)], ITEM)
    assert df.select(visuals.visual_section()).first()[0] == section


def test_numbers_and_captions(one):
    image = F.lit("image")
    assert [one(lambda c: visuals.visual_number(c, image), x) for x in ("Figure 3: x", "Fig. 3: x", "Fig 3: x", "Table 3")] == ["3", "3", "3", ""]
    assert one(visuals.number_refs, "Fig. 3 and Table 4, figure 3") == ["figure:3", "table:4"]
    assert one(visuals.chinese_caption, "Figure 1. Overview of UCDVER") == "通用跨域DVER 的整体框架"
    assert one(visuals.chinese_caption, "SOTA fine-tuning") == "当前最优 微调"


def test_place_visuals(spark):
    items = spark.createDataFrame([("d", 1, "image", "p", "Figure 1", None, None, None, None), ("d", 2, "table", "q", "accuracy results", None, None, None, None), ("e", 1, "image", "p", "x", None, None, None, None)], ITEM)
    summaries = spark.createDataFrame([("d", "## 方法概述\nx\n### 图12\n### 图1 结果\n## 主要结果\ny"), ("e", "no headings")], "doc string, md string")
    out = {(r["doc"], r["item_index"]): r["heading"] for r in visuals.place_visuals(items, summaries, "doc", "md").collect()}
    assert out == {("d", 1): "图1 结果", ("d", 2): "主要结果", ("e", 1): None}


def test_figures(spark):
    docs = spark.createDataFrame([("d", "Figure 1: one\nmore\n\nfig. 2 two\nTable 1 t\nx\nConclusion\ny"), ("e", None)], "k string, text string")
    labels = figures.figure_labels(docs, "k", "text")
    assert {r["label"]: r["caption"] for r in labels.collect()} == {"figure 1": "Figure 1: one more", "fig. 2": "fig. 2 two", "table 1": "Table 1 t x"}
    pages = spark.createDataFrame([("d", 0), ("d", 9)], "k string, page int")
    assert {(r["page"], r["label"]) for r in figures.page_captions(pages, labels, "k").collect()} == {(0, "table 1"), (9, None)}
    score = spark.createDataFrame([(1000, 1000, "c", 1), (10, 10, None, 2)], "w int, h int, c string, p int").select(figures.figure_score(F.col("w"), F.col("h"), F.col("c"), F.col("p"))).collect()
    assert [round(r[0], 4) for r in score] == [17.0, 0.001]


@pytest.mark.parametrize(
    "raw,tag", [("情感识别", "Emotion"), ("audio-driven", "Audio-Driven"), ("graph_neural-net", "Graph Neural Net"), ("图", None), ("123", None), ("llm", "LLM"), ("LoRA", "LoRA"), (None, None), ("GAZE", "GAZE")]
)
def test_tags(one, raw, tag):
    assert one(reports.normalize_tag, raw) == tag


def test_modality(spark):
    rows = spark.createDataFrame([(None, "Face video"), (None, "context"), (None, ""), ("Audio ", "video")], "e string, t string")
    assert [r[0] for r in rows.select(reports.modality(F.col("e"), F.col("t"))).collect()] == ["multimodal", "text", "image", "Audio"]


def test_rule_guards(one):
    for text in ("FER and cross domain", "crossdomain", "cross-domain denoising", "a clip of SOTA", "refer", "ucver", "udver ucdver"):
        import re

        want = [t for t, ps in reports.TAG_RULES if any(re.search(p, text.lower()) for p in ps)]
        assert one(reports.rule_tags, text) == want


def test_report_metadata(spark):
    schema = "stem string, full_text string, title string, paper_id string, keywords string, matched_keywords string, abstract string, venue string, year string"
    df = spark.createDataFrame([("2024_ICLR_AUHead_ Talking", "## Abstract\nOn speech.", None, None, "llm, gaze", "emotion", None, None, None), ("notes", None, "A B", "/blog/X 1/", None, None, None, "V", "1999")], schema)
    a, b = reports.report_metadata(df).collect()
    assert (a["year"], a["venue"], a["introduction"], a["id"]) == (2024, "ICLR", "On speech.", "auhead")
    assert a["tags"][0] == "Emotion" and len(a["tags"]) <= 5
    assert (b["id"], b["year"], b["venue"], b["title"]) == ("x-1", 2026, "V", "A B")
