import json

import pytest
from conftest import as_set
from pyspark.sql import functions as F

from rosterlens.operators.reshape import explode_json, pivot_entries, unpivot_slots
from rosterlens.operators.sets import fan_out_key, tagged_union
from rosterlens.plans.warehouse import d_post_simulation

FIELDS = ["questionId", "answerText"]


def test_slots_keep_ids_as_they_are_and_drop_blank_ones(frame):
    df = frame([("s", " K1 ", "one", " ", "two", None, "three")], "id string, a string, an string,"
               " b string, bn string, c string, cn string")
    slots = [{"skill": x, "name": f"{x}n"} for x in "abc"]
    assert as_set(unpivot_slots(df, ["id"], slots, "n", "skill")) == {("s", 1, " K1 ", "one")}


def test_json_keys_match_in_any_case_and_numbers_become_text(frame):
    rows = [
        ("a", json.dumps([{"questionId": "Q1", "answerText": 3}, {"QUESTIONID": "Q2", "answertext": None}])),
        ("none", None), ("empty", "[]"),
    ]
    out = explode_json(frame(rows, "id string, j string"), "j", FIELDS, ["id"])
    assert as_set(out) == {("a", "Q1", "3"), ("a", "Q2", None)}


def test_malformed_json_fails_unless_told_otherwise(frame):
    df = frame([("a", "[{")], "id string, j string")
    with pytest.raises(Exception):
        explode_json(df, "j", FIELDS, ["id"]).collect()
    assert explode_json(df, "j", FIELDS, ["id"], mode="PERMISSIVE").count() == 0


def test_pivot_matches_grouping(spark):
    entries = "transform(sequence(0, cast(id % 4 as int)), i -> named_struct('q', concat('Q', (id + i) % 5)," \
              " 'a', if((id + i) % 7 = 0, null, concat('t', (id * 31 + i * 17) % 101))))"
    df = spark.range(300).selectExpr("id", f"{entries} as e")
    out = pivot_entries(df, "e", "q", ["Q0", "Q2", "Q3"], ["a"], ["id"])
    grouped = (
        df.select("id", F.inline("e")).filter(F.col("q").isin("Q0", "Q2", "Q3"))
        .groupBy("id").pivot("q", ["Q0", "Q2", "Q3"]).agg(F.max("a").alias("a"))
        .select("id", F.col("Q0").alias("Q0_a"), F.col("Q2").alias("Q2_a"), F.col("Q3").alias("Q3_a"))
    )
    assert as_set(out) == as_set(grouped)


def survey(session, day, questions):
    text = questions if questions is None or isinstance(questions, str) else json.dumps(questions)
    return (session, " u ", "w", "true", day, text)


def q(i, question, answer, number):
    return {"questionId": i, "questionText": question, "answerText": answer, "selectedAnswerNumber": number}


SURVEY = ("`POST_SIMULATION.sessionId` string, `POST_SIMULATION.userid` string,"
          " `POST_SIMULATION.webportal` string, `POST_SIMULATION.finished` string,"
          " `POST_SIMULATION.recordedDate` string, `array_POST_SIMULATION.questions` string")


def test_survey_pivot(frame):
    rows = [
        survey(" s1 ", "2024-1-2 ", [q("Q1", " <p>Why?</p>&nbsp;", "b", 2), q("Q1", "Who?", "a", 10),
                                     q("Q99", "x", "y", 1), q("Q26", "z", None, None)]),
        survey("s1", "2024-01-01", [q("Q2", "old", "old", 1)]),
        survey("only-other", "2024-01-01", [q("Q99", "x", "y", 1)]),
        survey("none", "2024-01-01", None),
        survey("\t ", "2024-01-01", [q("Q1", "blank", "blank", 1)]),
    ]
    out = d_post_simulation(frame(rows, SURVEY)).collect()
    assert len(out) == 1 and len(out[0]) == 80
    row = out[0].asDict()
    assert (row["sessionid"], row["userid"], str(row["recordeddate"])) == ("s1", "u", "2024-01-02 00:00:00")
    # A repeated question gives the largest text of each field.
    assert (row["Q1_questionText"], row["Q1_answerText"], row["Q1_selectedAnswerNumber"]) == ("Why?", "b", "2")
    assert row["Q26_questionText"] == "z" and row["Q2_answerText"] is None
    assert list(row)[-6:-3] == ["Q62_questionText", "Q62_answerText", "Q62_selectedAnswerNumber"]


def test_fan_out_changes_the_key_only(frame):
    df = frame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    out = fan_out_key(df, "k", "a", ["x", "y"])
    assert as_set(out) == {("a", 1), ("x", 1), ("y", 1), ("b", 2), (None, 3)}
    assert out.columns == ["k", "v"]


def test_tagged_union_widens_and_fills(spark):
    live = spark.sql("select 1 as id, date'2024-01-01' as day, true as billable")
    other = spark.sql("select timestamp_ntz'2024-01-02 10:00:00' as day, 2 as id")
    out = tagged_union({"live": live, "ondemand": other}, "kind").orderBy("id").collect()
    assert [(r.kind, str(r.day), r.billable) for r in out] == [
        ("live", "2024-01-01 00:00:00", True), ("ondemand", "2024-01-02 10:00:00", None),
    ]


def test_of_repeated_keys_the_last_counts(frame):
    from rosterlens.operators.reshape import explode_json

    text = '[{"questionId": "a", "QuestionID": "b", "x": 1, "x": 2}, {"questionid": null, "y": 1}]'
    out = explode_json(frame([(1, text)], "id int, t string"), "t", ["questionId", "x"], ["id"])
    assert [tuple(r) for r in out.collect()] == [(1, "b", "2"), (1, None, None)]


def test_session_column_by_name(frame):
    extra = SURVEY + ", `POST_SIMULATION.parentSessionId` string"
    rows = [(*survey("s1", "2024-01-01", [q("Q1", "w", "b", 2)]), "p")]
    with pytest.raises(ValueError):
        d_post_simulation(frame(rows, extra))
    name = [c for c in frame(rows, extra).columns if c.lower().endswith("sessionid")][0]
    out = d_post_simulation(frame(rows, extra), session_id=name).collect()
    assert [r.sessionid for r in out] == ["s1"]
