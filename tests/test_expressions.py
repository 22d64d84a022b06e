import pytest
from pyspark.sql import functions as F

from rosterlens.functions import scoring, text


def run(frame, expression, values, kind="string"):
    df = frame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_trim_and_blank(frame):
    assert run(frame, text.trim_ws, ["\t a b \n\r\f\x0b", "  ", None]) == ["a b", "", None]
    assert run(frame, text.not_blank, [" x", " \t\n", "", None]) == [True, False, False, None]


def test_html_clean_trims_first(frame):
    assert run(frame, text.html_clean, [
        " <p> a</p>", "a&nbsp;b&amp;c", "<pre>x</pre>", None, "", "\ta\n", "a&rsquo;&hellip;b", "a < b",
    ]) == [" a", "ab&amp;c", "x", None, "", "a", "ab", "a < b"]


def test_strip_p_trims_last_and_takes_every_tag_in_p(frame):
    assert run(frame, text.strip_p, [
        " <p class='x'> a </p> ", "<pre>x</pre>", "<b>x</b>", "<param>y", None, "a&nbsp;",
    ]) == ["a", "x", "<b>x</b>", "y", None, "a&nbsp;"]


def test_parse_day(frame):
    days = [str(d) for d in run(frame, text.parse_day, [" 2024-01-05 ", "2024-1-5"])]
    assert days == ["2024-01-05 00:00:00"] * 2
    with pytest.raises(Exception, match="PARSE|parse"):
        run(frame, text.parse_day, ["soon"])


def test_tokens(frame):
    assert run(frame, text.tokens, ["SELECT * FROM {{ ref('f_score') }} is a", ""]) == [
        ["select", "from", "ref", "f_score"], [],
    ]


def test_passed(frame):
    assert run(frame, scoring.passed, [2, 3, 4, None], "int") == [0, 1, 1, None]


@pytest.mark.parametrize("title, kind, points", [
    (None, None, 1), (None, "Positive", 1), ("Strong", "Derailing", 4), ("Competent", None, 3),
    ("Emerging", "Positive", 2), ("Novice", "Positive", 1), ("Calm", "Positive", 3),
    ("Angry", "Derailing", 1), ("Calm", "Neutral", 0), ("Calm", None, 0),
])
def test_proficiency(frame, title, kind, points):
    df = frame([(title, kind)], "t string, k string")
    assert df.select(scoring.proficiency(F.col("t"), F.col("k"))).first()[0] == points


def test_session_status(frame):
    df = frame([(1, None), (0, "x"), (0, None), (None, "x")], "c int, s string")
    out = [r[0] for r in df.select(scoring.session_status(F.col("c"), F.col("s"))).collect()]
    assert out == ["COMPLETED", "IN_PROGRESS", "PENDING", "IN_PROGRESS"]


def test_is_positive(frame):
    assert run(frame, scoring.is_positive, ["Positive", "Derailing", None]) == [1, 0, 0]
