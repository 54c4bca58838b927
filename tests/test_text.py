import pytest
from pyspark.sql import functions as F

from litlake.functions import text as t
from litlake.functions.unicode import normal_form

CASES = [
    (t.sanitize_filename, "A: B?", "A_ B_"),
    (t.sanitize_filename, "x/y.", "x_y"),
    (t.sanitize_filename, "a" * 250, "a" * 200),
    (t.slug, "Hello, World!", "hello-world"),
    (t.slug, "情感", ""),
    (t.safe_stem, " a  b??c. ", "a b_c"),
    (t.safe_stem, "", "paper"),
    (t.acronym, "AUHead: Realistic", "AUHead"),
    (t.acronym, "well-known: x", ""),
    (t.acronym, "self: x", "self"),
    (t.infer_year, "NeurIPS2025", 2025),
    (t.infer_year, "", 2026),
    (t.infer_year, None, 2026),
    (t.clean_title, "2026_ICLR_A  title.", "A title"),
    (t.markdown_title, "x\n# The title #\n## y", "The title #"),
    (t.heading_key, "## 3.1 图 12：结果", "图12结果"),
    (t.intro_text, "# **A** [b](http://c) ![i](p) <b>d</b>", "A b d"),
    (t.strip_html, "<table><tr><td>a</td><td>b &amp; c</td></tr></table>", "a | b & c |"),
    (t.escape_html, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"),
    (t.normalize_text, "a\x00 \t b\n\n\n\nc ", "a b\n\nc"),
    (t.url_host, "https://papers.example.org:80/x?y", "papers.example.org"),
    (t.strip_query, "http://a/b?c#d", "http://a/b"),
    (t.pdf_url, "https://openreview.net/forum?id=q1", "https://openreview.net/pdf?id=q1"),
    (t.pdf_url, "https://openreview.net/forum?id=forumX", "https://openreview.net/pdf?id=pdfX"),
    (t.pdf_url, "https://ojs.aaai.org/index.php/AAAI/article/view/1/2", "https://ojs.aaai.org/index.php/AAAI/article/download/1/2"),
    (t.base_name, "a\\b/c.pdf", "c.pdf"),
    (t.has_han, "情", True),
    (t.is_external_image, "data:x", True),
    (t.is_external_image, "images/x.png", False),
    (t.is_blank, None, True),
    (t.is_blank, "　\n", True),
    (t.squeeze, "　a 　\nb ", "a b"),
    (t.chat_content, '{"choices":[{"message":{"content":"hi"}}]}', "hi"),
    (t.chat_content, '{"content":"", "data":"d"}', "d"),
    (t.chat_content, "no json", ""),
    (normal_form, "Ｆｕｌｌ ﬁ\tX", "full fi x"),
]


@pytest.mark.parametrize("function,value,expected", CASES)
def test_values(one, function, value, expected):
    assert one(function, value) == expected


def test_arrays(one):
    assert one(t.simple_sentences, "甲乙。丙丁！戊") == ["甲乙。", "丙丁！", "戊"]
    assert one(t.split_list, "a, b;|c、，d；") == ["a", "b", "c", "d"]
    assert one(t.split_list, None) == []
    assert one(lambda c: t.distinct_ignoring_case(t.split_list(c)), "Emotion,emotion,CLIP,clip,Text") == ["Emotion", "CLIP", "Text"]
    assert one(t.markdown_headings, "# a\nx\n#### b\n##### c") == ["# a", "#### b"]


def test_join_url(one):
    base = F.lit("http://a/b/")
    assert one(lambda c: t.join_url(base, c), "/c") == "http://a/b/c" and one(lambda c: t.join_url(base, c), "https://q") == "https://q"


def test_structs(one):
    assert tuple(one(t.source_of_stem, "2026_ICLR_A_ B_")) == ("2026", "ICLR", "A:  B:")
    assert tuple(one(t.source_of_stem, "notes")) == ("", "", "notes")
    assert tuple(one(t.source_of_file, "neurips2025_metadata")) == ("NEURIPS", "2025")
    assert tuple(one(t.source_of_file, "ICLR_2026")) == ("ICLR", "2026")
    assert one(t.source_of_file, "filtered_papers") is None
    assert tuple(one(t.bibliography_line, "+ A title. [Paper](http://x)")) == ("A title.", "http://x")
    assert one(t.bibliography_line, "no") is None


def test_truncation(one):
    assert one(t.truncate, "abcdefghij", 8) == "abcde..."
    assert one(t.head_tail, "abcdefghijklmnopqrst", 10, "|") == "abcdef|qrst"
    assert one(t.truncate_bytes, "中文字", 7) == "中文"
    assert one(t.truncate_intro, "句。" * 200, 320).endswith("。")
    name = one(t.upload_name, "中" * 80 + ".pdf")
    assert len(name.encode()) <= 120 and name.endswith(".pdf")
    assert one(t.upload_name, "short.pdf") == "short.pdf"


def test_short_titles(spark):
    rows = spark.createDataFrame([("One Two Three Four Five Six", "stem"), ("Two words", "stem"), ("情感", "stem"), ("情感", "ABC: x")], "a string, b string")
    out = [r[0] for r in rows.select(t.short_title(F.col("a"), F.col("b"))).collect()]
    assert out == ["One Two Three Four", "Two words", "stem", "ABC"]


def test_named_section_and_leading_text(one):
    md = "# T\n\n![x](y)\n## Abstract\nfirst\n\nsecond\n## Next\nno"
    assert one(t.named_section, md, "abstract") == "first second"
    assert one(t.named_section, md, "missing") == ""
    assert one(t.leading_text, "![a](b)\n<p>\n\nx\ny") == "x y"


def test_cache_stem(one):
    long = "2026_ICLR_" + "very long title " * 10
    out = one(t.cache_stem, long)
    assert len(out) <= 72 and out.startswith("2026_ICLR_very_long") and len(out.rsplit("-", 1)[1]) == 10
    assert one(t.cache_stem, "a b") == "a_b"
