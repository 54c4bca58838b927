import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litlake.operators.packed import explode_packed, split_packed

CASES = [
    (None, []),
    ("", []),
    (" , ;", []),
    ("[]", []),
    ("a", ["a"]),
    ("Gaze, Pain;  Trust ", ["gaze", "pain", "trust"]),
    ("a，b、c；d｜e", ["a", "b", "c", "d", "e"]),
    ("a | b / c · d", ["a", "b", "c", "d"]),
    ("human/robot, data & privacy, speaker's stance, few-shot", ["human/robot", "data & privacy", "speaker's stance", "few-shot"]),
    ('"faces, in the wild", b', ["faces, in the wild", "b"]),
    ("“emotion; mixed”、b", ["emotion; mixed", "b"]),
    ('"so-called ""raw"" affect", x', ['so-called "raw" affect', "x"]),
    ('"""raw"" affect", x', ['"raw" affect', "x"]),
    ('["so-called \\"raw\\" affect", "\\u60c5\\u611f", "a\\u00a0b"]', ['so-called "raw" affect', "情感", "a b"]),
    ("['a, b', \"speaker's stance\", 'c']", ["a, b", "speaker's stance", "c"]),
    ('["it\'s a", \'b, c\', \'d\']', ["it's a", "b, c", "d"]),
    ("[a; b; speaker's stance]", ["a", "b", "speaker's stance"]),
    ("Keywords: a, b.", ["a", "b"]),
    ("关键词：- a\n- b", ["a", "b"]),
    ("[• a]", ["a"]),
    ("[- a\n- b]", ["a", "b"]),
    ("Index Terms—a; b", ["a", "b"]),
    ("Key words - • a\n• \"b, c\"", ["a", "b, c"]),
    ("1. a\n2. b", ["a", "b"]),
    ("a\tb\tA", ["a", "b", "a"]),
    ("3D faces, 5 senses", ["3d faces", "5 senses"]),
    ("ｆｕｌｌ　ｗｉｄｔｈ, ﬁne", ["full width", "fine"]),
    ('a "b" c, d', ['a "b" c', "d"]),
    ('an "open, b', ['an "open', "b"]),
    ('"a"\n"b"\t"c"', ["a", "b", "c"]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_cases(one, text, expected):
    assert one(split_packed, text) == expected


def test_long_field_and_many_quotes(one):
    long = ", ".join(f'"a ""{i}"" b, c"' for i in range(20_000))
    out = one(split_packed, long)
    assert len(out) == 20_000 and out[7] == 'a "7" b, c'
    assert len(one(split_packed, "x" * 1_000_000)[0]) == 1_000_000


def test_rows_order_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a, b", "o", "i"), (1, "a, b", "o", "i"), (2, None, None, None)], "pos long, k string, ord string, item string")
    rows = explode_packed(df, "k", ["pos"]).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert explode_packed(df.limit(0), "k", ["pos"]).columns == ["pos", "ord", "item"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcz &'/-", min_size=1, max_size=12).map(str.strip).filter(lambda s: s and s[0].isalpha() and s[-1].isalpha() and " /" not in s and "/ " not in s), min_size=1, max_size=5))
def test_quoting_round_trip(spark, values):
    field = ", ".join('"' + v + ", x\"" for v in values)
    df = spark.createDataFrame([(field,)], "v string")
    assert df.select(split_packed(F.col("v"))).first()[0] == [" ".join(v.split()) + ", x" for v in values]
