from conftest import as_set

from rosterlens.operators.cdc import latest_row, undeleted_groups
from rosterlens.plans import warehouse as w

OPS = [
    ("i", "I"), ("iu", "I"), ("iu", "U"), ("id", "I"), ("id", "D"), ("d", "D"), ("null", None),
    ("nulld", None), ("nulld", "D"),
]


def kept(df, key):
    return {r[key] for r in df.collect()}


def test_newest_archived_row_hides_the_key(frame):
    rows = [("a", False, 0), ("a", True, 1), ("b", True, 0), ("b", False, 1), ("c", False, 5)]
    out = w.d_client(frame(rows, "id string, archived boolean, modify_revision long"))
    assert as_set(out) == {("b", False, 1, 1), ("c", False, 5, 1)}


def test_nulls_sort_last_in_both_directions(frame):
    df = frame([("a", None, "x"), ("a", 1, "y"), ("a", 2, "z")], "k string, v int, w string")
    assert latest_row(df, ["k"], [("v", "asc")]).first()["w"] == "y"
    assert latest_row(df, ["k"], [("v", "desc")]).first()["w"] == "z"


def test_null_keys_form_one_group(frame):
    df = frame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    assert as_set(latest_row(df, ["k"], [("v", "desc")], keep_rank=False)) == {(None, 2), ("a", 1)}


def test_ties_fall_to_the_other_columns_or_the_given_ones(frame):
    df = frame([("a", 1, "q", 1), ("a", 1, "p", 2)], "k string, v int, w string, x int")
    assert latest_row(df, ["k"], [("v", "desc")]).first()["w"] == "p"
    assert latest_row(df, ["k"], [("v", "desc")], tiebreak=["x"]).first()["w"] == "q"


def test_dotted_names(frame):
    df = frame([("a", 1), ("a", 2)], "`x.k` string, `x.v` int")
    assert latest_row(df, ["x.k"], [("x.v", "desc")]).first()["x.v"] == 2


def test_four_ways_to_treat_deletes(frame):
    goals = frame([(k, 1, op) for k, op in OPS], "scenario_id string, goal_index int, op string")
    # Descending: U over I over D, and NULL last.
    assert kept(w.d_scenario_goals(goals), "scenario_id") == {"i", "iu", "id", "null"}

    members = frame([(k, "r", op) for k, op in OPS], "team_id string, user_role_id string, op string")
    # Ascending: a delete wins over I and U, and keys with NULL only are dropped.
    assert kept(w.m_team_member(members), "team_id") == {"i", "iu"}

    teams = frame([(k, "t", op) for k, op in OPS], "scenario_id string, team_id string, op string")
    assert kept(w.m_scenario_team(teams), "scenario_id") == {k for k, _ in OPS}

    learners = frame([(k, "r", op) for k, op in OPS], "session_id string, user_role_id string, op string")
    assert as_set(w.m_session_learner(learners)) == {
        (k, "r", "0") for k in ("i", "iu", "null")
    }


def test_mapping_drops_deleted_and_archived(frame):
    rows = [
        ("I", "a", "x", 1, False), ("D", "a", "x", 2, False),
        (None, "b", "x", 1, False), ("I", "c", "x", 1, True),
        ("I", "d", "old", 1, False), ("U", "d", "new", 1, False),
    ]
    out = w.f_skill_domain_mapping(
        frame(rows, "op string, skill_id string, domain_id string, operated_on int, archived boolean")
    )
    assert {(r.skill_id, r.domain_id) for r in out.collect()} == {("b", "x"), ("d", "new")}


def test_scores_keep_the_row_created_first(frame):
    rows = [("a", 2, 9, 20.0), ("a", 1, 5, 10.0), ("a", 1, 6, 11.0), ("a", None, 9, 99.0), ("b", None, 1, 7.0)]
    raw = frame(
        [(i, c, u, None, "s", v, "g", "u", "c") for i, c, u, v in rows],
        "id string, createdat int, updatedat int, deletedat int, sessionid string, score double,"
        " goaldescription string, userid string, clientid string",
    )
    assert {(r.id, r.score) for r in w.f_session_score(raw).collect()} == {("a", 11.0), ("b", 7.0)}


def test_undeleted_groups_ignores_repeats(frame):
    df = frame([("s", "r", "I")] * 3 + [("t", "r", "D")], "s string, r string, op string")
    assert as_set(undeleted_groups(df, ["s", "r"])) == {("s", "r", "0")}


def test_hot_key_is_cut_down_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as v", "id * 2 as w")
    plan = latest_row(df, ["k"], [("v", "desc")])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_maps_inside_structs_are_no_tiebreak(spark):
    df = spark.sql("SELECT 1 AS id, 1 AS v, named_struct('m', map('a', 1)) AS s, array(map('a', 1)) AS l, 'x' AS t")
    assert latest_row(df, ["id"], [("v", "desc")]).count() == 1
