"""What lies on disk at once: shuffles of what was written are gone, and rows are shuffled once for lookups that share a key."""

import os
import re
import time

import pytest

import __spark_entry__ as entry
from rosterlens.operators.heavy import KeySketches
from rosterlens.plans import marts, warehouse
from rosterlens.sources.staging import ALL_KEYS, CLEANUP, stage, staging_dir

FOLDER = "/root/testdata/sf0.001"


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}


def gone(spark, before):
    for _ in range(100):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_shuffles_of_a_staged_table_are_removed(spark):
    before = shuffle_files(spark)
    rows = stage(spark.range(10_000).selectExpr("id % 100 as k", "id").repartition(8, "k").groupBy("k").count())
    assert gone(spark, before)
    assert rows.count() == 100 and rows.agg({"count": "sum"}).first()[0] == 10_000
    assert spark.conf.get(CLEANUP) == "false"


def test_the_setting_is_put_back_after_a_failure(spark):
    bad = spark.sql("select raise_error('no') as x")
    with pytest.raises(Exception, match="no"):
        stage(bad)
    assert spark.conf.get(CLEANUP) == "false"


SURVEY = ["webportal", "finished", "recordedDate", "generationType", "score", "strengthassessmentid", "opportunitiesassessmentid"]


class Known:
    """Lists of keys as sketches give them; those not named are empty, so that no key is large."""

    def __init__(self, **lists):
        self.lists = lists

    def of(self, table, *on):
        return self.lists.get(table, [])


@pytest.fixture
def merged(spark):
    """Joins as large tables have them, under the settings of a write by one key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(ALL_KEYS, "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset(ALL_KEYS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_stay_where_they_are_dealt_when_written_by_one_key(spark, tmp_path):
    left, right = spark.range(100).selectExpr("id % 5 as a", "id as b"), spark.range(50).selectExpr("id % 5 as a", "id as b", "1 as c")
    names = spark.range(5).selectExpr("id as a", "id as name")
    joined = left.join(names.hint("merge"), "a", "left").join(right.hint("merge"), ["a", "b"], "left")
    before = spark.conf.get(ALL_KEYS)
    rows = stage(joined, by_one_key=True)
    assert spark.conf.get(ALL_KEYS) == before == "true"
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)


def test_a_large_scenario_is_dealt_by_all_keys():
    assert marts.dealt_by_scenario(Known(), "f_sessions_final", "assignments")
    assert marts.dealt_by_scenario(Known(assignments=[("2:S1", 7)]), "assignments", split_rows=7)
    assert not marts.dealt_by_scenario(Known(assignments=[("2:S1", 8)]), "f_sessions_final", "assignments", split_rows=7)
    assert not marts.dealt_by_scenario(KeySketches(), "f_sessions_final")  # not known
    assert not marts.dealt_by_scenario(None, "f_sessions_final")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_wide_rows_are_not_dealt_again_for_their_sessions(spark, merged):
    trial = entry.Trial(spark, FOLDER, entry.USED["team_sessions_final"], **entry.READS["team_sessions_final"])
    text = plan_of(trial.model("f_team_sessions_final"))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert [d for d in dealt if "user_id" in d and "scenario_id" in d] == []
    assert len([d for d in dealt if re.search(r"scenario_id#\d+, _deal#", d)]) == 3  # rows, scenarios, sessions


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_banks_and_events_are_met_where_rows_are(spark, merged):
    written = entry.Trial(spark, FOLDER, f_score=1, f_team_sessions_final=1)
    tables = {n: written[n] for n in entry.inputs("f_score")}
    text = plan_of(marts.scored_rows(**tables, keys=Known()))
    assert not re.search(r"Exchange hashpartitioning\([^)]*event_number", text)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_what_is_staged_for_the_score_mart_on_the_way_is_removed(spark):
    trial = entry.Trial(spark, FOLDER, f_score=1)
    trial["f_team_sessions_final"]
    folder = staging_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = trial.model("f_score")
    assert len(set(os.listdir(folder)) - before) == 1
    assert rows.count() > 0


def team_tables(frame):
    nothing = ", ".join(f"{c} string" for c in marts.SESSION_COLUMNS)
    session = lambda i, user, scenario: (i, user, scenario, "live", *[None] * len(marts.SESSION_COLUMNS))
    return {
        "d_users": frame(
            [("U1", None, "A", "B", "a@b"), ("U2", None, "C", "D", "c@d"), (None, None, "E", "F", "e@f")],
            "id string, activation_date timestamp_ntz, first_name string, last_name string, email string"),
        "m_user_client": frame([("U1", "C1")], "id string, client_id string"),
        "d_client": frame([("C1", "one", False, "G")], "id string, name string, archived boolean, operated_by string"),
        # U9 has roles and sessions, and is no user.
        "m_client_user_role": frame(
            [("R1", "U1", "learner"), ("R2", "U1", "facilitator"), ("R9", "U9", "learner"), ("R8", "U9", "learner")],
            "id string, user_id string, role string"),
        "m_team_member": frame([("R1", "T1"), ("R9", "T1")], "user_role_id string, team_id string"),
        "d_team": frame([("T1", "team")], "id string, name string"),
        "m_scenario_team": frame([("S1", "T1")], "scenario_id string, team_id string"),
        "f_sessions_final": frame(
            [session("L1", "U1", "S1"), session("L2", "U1", "S1"), session("L3", "U9", "S1"), session("L4", "U2", "S2"), session("L5", None, "S1")],
            f"id string, learner_id string, scenario_id string, session_type string, {nothing}"),
        "d_scenario": frame(
            [("S1", "s", "c", "P1", "C1", 1)],
            "id string, name string, name_customized string, project_id string, client_id string, generation_type int"),
        "d_project": frame([("P1", "p")], "id string, name string"),
        "raw_scenario_team": frame([("S1", "T1")], "scenario_id string, team_id string"),
        "raw_team_member": frame([("R1", "T1"), ("R9", "T1")], "user_role_id string, team_id string"),
    }


@pytest.mark.parametrize("split_rows, keys", [
    (5_000_000, None), (5_000_000, Known()), (1, None),
    # All keys are large and listed, one of them of roles without a user.
    (1, Known(
        m_client_user_role=[("2:U1", 2), ("2:U9", 2)], f_sessions_final=[("2:U12:S1", 2)], m_team_member=[], m_scenario_team=[])),
])
def test_roles_and_sessions_of_known_and_unknown_users(frame, split_rows, keys):
    rows = marts.team_sessions(**team_tables(frame), split_rows=split_rows, keys=keys).select(
        "user_id", "user_role", "team_name", "scenario_name", "session_id", "client_name", "email")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        *[("U1", role, "team", "s", session, "one", "a@b") for role in ("learner", "facilitator") for session in ("L1", "L2")],
        # One of the roles is in no team.
        *[("U1", role, None, None, None, "one", "a@b") for role in ("learner", "facilitator")],
        ("U9", None, "team", "s", "L3", "one", None),
        ("U2", None, None, None, "L4", None, "c@d"), ("U2", None, None, None, None, None, "c@d"),
        # A user without an id is looked up by NULL, which finds nobody.
        (None, None, None, None, None, None, None),
    ], key=str)


def live_tables(frame):
    names = ["op", "SIM_FEEDBACK.sessionId", *[f"SIM_FEEDBACK.{c}" for c in SURVEY]]
    names += [f"SIM_FEEDBACK.{c}" for n in range(1, 6) for c in (f"event{n}skillid", f"event{n}skillname", f"selectedevent{n}mindsetid")]
    schema = ", ".join(f"`{n}` {'int' if n.endswith('.score') else 'string'}" for n in names)
    slots = ["K1", "one", "M1", "K1", "two", "M2", "K2", "three", "M3", "K9", "four", None, None, None, "M1"]
    return {
        "raw_sim_feedback": frame([("I", "L1", "web", "true", "2024-01-01", "gen", 3, "A", "B", *slots)], schema),
        # M1 is repeated and known, M2 known only, M3 repeated only; a NULL matches nothing.
        "m_skill_score_mindset": frame(
            [("E1", "M1", "t"), ("E2", "M1", "t"), ("E3", "M3", "t"), ("E4", "M3", "t"), ("E5", None, "t")],
            "events_mindset_id string, mindset_id string, type string"),
        "f_skill_domain_mapping": frame([("K1", "B1")], "skill_id string, domain_id string"),
        "d_building_blocks": frame(
            [("B1", "Strong", "skill", "Positive", "l"), ("B2", "Novice", "mindset", "Derailing", "l")],
            "id string, title string, building_block_type string, type string, level string"),
        "f_events_mindset": frame([("M1", "B2"), ("M2", "B1"), (None, "B1")], "id string, mindset_id string"),
    }


@pytest.mark.parametrize("split_rows", [1, 5_000_000])
def test_repeats_and_competencies_are_looked_up_as_before(frame, split_rows):
    rows = warehouse.f_live_skills(**live_tables(frame), split_rows=split_rows).select("event_number", "mindset_id", "CompetencyID", "skill_name").collect()
    assert sorted(map(tuple, rows)) == [
        (1, "M1", "B2", "Strong"), (1, "M1", "B2", "Strong"), (2, "M2", "B1", "Strong"), (3, "M3", None, None), (3, "M3", None, None),
        (4, None, None, None),
    ]


def test_events_are_shuffled_once_for_both_lookups_by_mindset(spark, frame):
    tables, keys = live_tables(frame), KeySketches()
    keys.watch("m_skill_score_mindset", tables["m_skill_score_mindset"], [("mindset_id",)]).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = warehouse.f_live_skills(**tables, keys=keys)
        text = events._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"SortMergeJoin \[mindset_id.*LeftOuter", text)) == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_shared_tables_are_written_with_the_columns_in_use(spark):
    trial = entry.Trial(spark, FOLDER, entry.USED["routing_join"], **entry.READS["routing_join"])
    assert trial["f_live_skills"].columns == ["sessionid", "event_number", "skill_id"]
    assert trial.keys.of("f_live_skills", "sessionid") is not None
