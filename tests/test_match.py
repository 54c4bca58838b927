import pytest
from pyspark.sql import functions as F

from litlake.operators import match

SCHEMA = "title string, abstract string, keywords string, type string"


@pytest.fixture
def papers(spark):
    return spark.createDataFrame(
        [("Emotion in LLMs", None, "affect", " Oral "), ("Vision", None, None, "poster"), ("Stimotion", "", "", None), ("EMOTION", "audio", "", "Poster")], SCHEMA
    )


def run(df, *args, **more):
    return [(r["title"], r["matched_keywords"]) for r in match.filter_papers(df, *args, **more).collect()]


def test_any_all_and_substring(papers):
    assert run(papers, ["emotion", "affect"]) == [("Emotion in LLMs", "emotion, affect"), ("EMOTION", "emotion")]
    assert run(papers, ["emotion", "audio"], match_all=True) == [("EMOTION", "emotion, audio")]
    assert ("Stimotion", "motion") in run(papers, ["motion"])


def test_null_text(papers):
    assert ("Vision", "nan") in run(papers, ["nan"], null_text="nan")
    assert run(papers, ["nan"]) == []


def test_case_and_regex(papers):
    assert run(papers, ["emotion"], ["title"], case_sensitive=True) == []
    assert run(papers, ["^emo"], ["title"], regex=True) == [("Emotion in LLMs", "^emo"), ("EMOTION", "^emo")]


def test_types(papers):
    assert [t for t, _ in run(papers, ["o"], ["title"], allowed_types=["oral"])] == ["Emotion in LLMs"]
    assert run(papers, ["o"], ["title"], allowed_types=[]) == []


def test_errors(papers):
    with pytest.raises(ValueError):
        match.filter_papers(papers, [])
    with pytest.raises(KeyError):
        match.filter_papers(papers, ["a"], ["none"])
    with pytest.raises(KeyError):
        match.filter_papers(papers.drop("type"), ["a"], allowed_types=["oral"])


def test_empty_table_and_extra_columns(papers):
    assert run(papers.limit(0), ["a"]) == []
    wide = papers.withColumn("matched_keywords", F.lit("old")).withColumn("text", F.lit(1))
    assert run(wide, ["vision"]) == [("Vision", "vision")]


def test_submission_types(one):
    for value, expected in [("ICLR 2026 Oral", "oral"), ("Spotlight Poster", "spotlight"), ("Submitted to ICLR 2026", "submitted to iclr 2026"), (None, "unknown"), ("", "unknown"), ("Temporal workshop poster", "oral")]:
        assert one(match.submission_type, value) == expected


def test_title_filter_and_patterns(spark, papers):
    df = papers.withColumn("source_file", F.lit("f"))
    out = match.title_filter(df, "EMOTION", ["oral", "poster"])
    assert out.columns[0] == "source_file" and [r["title"] for r in out.collect()] == ["EMOTION"]
    assert match.title_filter(df.drop("type"), "x", ["oral"]).count() == 0
    assert [r[0] for r in papers.select(match.pattern_provenance(F.col("title"), ["Emo", "EMO", "V"])).collect()] == ["Emo", "V", "", "EMO"]


def test_faceted_search(spark):
    df = spark.createDataFrame(
        [("1", "A", "A", "intro gaze", "V", 2024, "text", ["X"]), ("2", "B", "B", None, "W", None, "text", [])],
        "id string, title string, fullTitle string, introduction string, venue string, year int, modality string, tags array<string>",
    )
    assert [r["id"] for r in match.faceted_search(df, "GAZE", "V", "2024", "text", "X").collect()] == ["1"]
    assert match.faceted_search(df).count() == 2 and match.faceted_search(df, tag="Y").count() == 0
