"""Small hand-made tables for the rules that are easy to get wrong."""

from collections import Counter

from conftest import as_set

from rosterlens.plans import marts, warehouse as w
from rosterlens.sources.staging import stage

SLOT = ", ".join(
    f"`SIM_FEEDBACK.event{n}skillid` string, `SIM_FEEDBACK.event{n}skillname` string,"
    f" `SIM_FEEDBACK.selectedevent{n}mindsetid` string"
    for n in range(1, 6)
)
FEEDBACK = (
    "op string, `SIM_FEEDBACK.trainingSessionId` string, `SIM_FEEDBACK.webportal` string,"
    " `SIM_FEEDBACK.finished` string, `SIM_FEEDBACK.recordedDate` string,"
    " `SIM_FEEDBACK.generationType` string, `SIM_FEEDBACK.score` int,"
    " `SIM_FEEDBACK.strengthassessmentid` string, `SIM_FEEDBACK.opportunitiesassessmentid` string, " + SLOT
)


def feedback(session, day, score, *slots, op="I"):
    filled = [v for slot in slots for v in slot] + [None] * (15 - 3 * len(slots))
    return (op, session, "w", "true", day, "g", score, "A", "B", *filled)


def live_skills(frame, rows, mindsets=(), blocks=(), mapping=()):
    events_mindset = frame(list(mindsets), "id string, mindset_id string")
    building_blocks = frame(
        list(blocks), "id string, title string, type string, building_block_type string, level string"
    )
    return w.f_live_skills(
        frame(rows, FEEDBACK),
        w.m_skill_score_mindset(events_mindset, building_blocks),
        frame(list(mapping), "skill_id string, domain_id string"),
        building_blocks,
        events_mindset,
    )


def test_latest_survey_by_trimmed_day_then_op(frame):
    rows = [
        feedback(" s1", "2024-1-9 ", 3, ("K1", "<p>a</p>", None)),
        feedback("s1 ", " 2024-01-10", 2, ("K2", "<p> b </p>", None)),
        feedback("s1", "2024-01-10", 5, ("K3", "c", None), op="U"),
        feedback("  ", "2024-01-10", 5, ("K4", "c", None)),
    ]
    out = live_skills(frame, rows).collect()
    assert [(r.trainingsessionid, r.skill_id, r.score, r.skill_score, r.old_skill_name) for r in out] == [
        ("s1", "K3", 1, 1, "c")
    ]


def test_a_match_of_the_unused_join_repeats_rows(frame):
    # The mindset id B1 is both an event-mindset id and a mindset that two event-mindsets name.
    rows = [feedback("s1", "2024-01-01", None, ("K1", "x", "B1"), ("K2", "x", "M9"))]
    out = live_skills(
        frame, rows,
        mindsets=[("M1", "B1"), ("M2", "B1"), ("B1", "B2")],
        blocks=[("B1", "One", "Positive", "t", "l"), ("B2", "Strong", "Derailing", "t", "l")],
        mapping=[("K1", "B1")],
    )
    assert Counter((r.skill_id, r.skill_score, r.mindset_score, r.skill_name, r.score) for r in out.collect()) == {
        ("K1", 4, "Strong", "One", None): 2, ("K2", 1, None, None, None): 1,
    }


def test_ondemand_ranks_by_skill_within_session(frame):
    skills = frame(
        [("1", "b", 2.0, "S1"), ("2", "a", 1.0, "S1"), ("3", None, 3.0, "S1"), ("4", "a", 4.0, None)],
        "id string, skill string, score double, sessionscoreid string",
    )
    scores = frame([("S1", "o1", 9.0)], "id string, sessionid string, score double")
    assert as_set(w.f_ondemand_skills(skills, scores)) == {
        ("o1", "a", 1.0, 9.0, 1), ("o1", "b", 2.0, 9.0, 2), ("o1", None, 3.0, 9.0, 3),
        (None, "a", 4.0, None, 1),
    }


SESSION = (
    "id string, scenario_id string, status string, actual_start_date timestamp_ntz,"
    " actual_end_date timestamp_ntz, start_date timestamp_ntz, end_date timestamp_ntz, billable boolean,"
    " sub_type string, late_canceled boolean, final_session_sub_status string, session_date date"
)


def test_persons_in_other_roles_stay_without_an_id(frame):
    sessions = frame([("s1", "S", *[None] * 10), ("s2", "S", *[None] * 10)], SESSION)
    present = frame([("s1", "r1"), ("s1", "r2"), ("s1", "r3")], "session_id string, user_role_id string")
    roles = frame(
        [("r1", "u1", "learner"), ("r2", "u2", "facilitator")], "id string, user_id string, role string"
    )
    out = marts.live_sessions(sessions, present, roles)
    assert Counter((r.id, r.learner_id) for r in out.collect()) == {
        ("s1", "u1"): 1, ("s1", None): 2, ("s2", None): 1,
    }


class Small:
    """A few users, teams, scenarios and sessions; every table of the marts."""

    def __init__(self, frame):
        self.d_users = frame(
            [("u1", "Ann", "Lee"), ("u2", "Bo", None), ("u3", "Cy", "X")],
            "id string, first_name string, last_name string",
        ).selectExpr("*", "'e' as email", "timestamp_ntz'2020-01-01' as activation_date")
        self.m_user_client = frame([("u1", "c1"), ("u2", "gone")], "id string, client_id string")
        self.d_client = frame([("c1", "One"), ("c2", "Two")], "id string, name string").selectExpr(
            "*", "false as archived", "'op' as operated_by"
        )
        self.m_client_user_role = frame(
            [("r1", "u1", "learner"), ("r1f", "u1", "facilitator"), ("r2", "u2", "learner"),
             ("r9", "u9", "learner")],
            "id string, user_id string, role string",
        )
        # u1 is in two teams; u2 once was in team t2, both rows of which are deletes.
        self.m_team_member = frame(
            [("r1", "t1"), ("r1", "t2")], "user_role_id string, team_id string"
        )
        self.raw_team_member = frame(
            [("I", "r1", "t1"), ("I", "r1", "t2"), ("D", "r2", "t2")],
            "op string, user_role_id string, team_id string",
        )
        self.d_team = frame([("t1", "First"), ("t2", "Second")], "id string, name string")
        self.m_scenario_team = frame([("S1", "t1"), ("S1", "t2")], "scenario_id string, team_id string")
        self.raw_scenario_team = frame(
            [("I", "S1", "t1"), ("I", "S1", "t2"), ("D", "S2", "t2")],
            "op string, scenario_id string, team_id string",
        )
        self.d_scenario = frame(
            [("S1", "c2", 1), ("S2", "c9", 1)], "id string, client_id string, generation_type int"
        ).selectExpr("*", "concat('n', id) as name", "null as name_customized", "'p' as project_id")
        self.d_project = frame([("p", "Project")], "id string, name string")
        self.f_sessions_final = frame(
            [("s1", "S1", "u1", "live"), ("s2", "S2", "u2", "ondemand"), ("s3", "S3", "u9", "live"),
             ("s4", None, "u1", "live"), ("s5", "S1", None, "live")],
            "id string, scenario_id string, learner_id string, session_type string",
        ).selectExpr("*", *[
            "cast(null as string) as " + c
            for c in marts.SESSION_COLUMNS if c != "start_date"
        ], "timestamp_ntz'2024-01-01' as start_date")

    def rows(self, client="c2", **sizes):
        from inspect import Parameter, signature

        needed = [
            n for n, p in signature(marts.f_team_sessions_final).parameters.items()
            if p.default is Parameter.empty
        ]
        return marts.f_team_sessions_final(
            **{n: getattr(self, n) for n in needed}, fan_out_client=client, fan_out_copies=("x", "y"), **sizes
        )


def test_team_sessions(frame):
    out = Small(frame).rows(client="none")
    found = Counter(
        (r.user_id, r.client_id, r.client_user_role_id, r.team_name, r.scenario_id, r.session_id, r.full_name)
        for r in out.collect()
    )
    assert found == Counter({
        # Two roles times two teams, the session repeated for each.
        ("u1", "c2", "r1", "First", "S1", "s1", "Ann Lee"): 1,
        ("u1", "c2", "r1", "Second", "S1", "s1", "Ann Lee"): 1,
        ("u1", "c2", "r1f", "First", "S1", "s1", "Ann Lee"): 1,
        ("u1", "c2", "r1f", "Second", "S1", "s1", "Ann Lee"): 1,
        # The facilitator role is in no team.
        ("u1", "c1", "r1", None, None, None, "Ann Lee"): 1,
        ("u1", "c1", "r1f", None, None, None, "Ann Lee"): 1,
        ("u2", None, "r2", None, None, None, None): 1,
        # Known from a session only; the team comes from ended rows of the raw feeds.
        ("u2", None, "r2", "Second", "S2", "s2", None): 1,
        ("u3", None, None, None, None, None, "Cy X"): 1,
        # A learner without a current user row.
        ("u9", None, None, None, "S3", "s3", None): 1,
    })
    assert len(out.columns) == 32


def score(frame, small, client, **sizes):
    skills = frame([("s2", "Listening", 2.0, 8.0)], "sessionid string, skill string, skill_score double,"
                   " SessionScore double")
    live = frame(
        [("s1", "Domain", 4, 1, 1, "K", "Positive", "old"), ("s1", "Domain", 3, 1, 7, "K", None, "old"),
         ("s2", "never", 3, 1, 1, "K", None, "old")],
        "sessionid string, skill_name string, skill_score int, score int, event_number int, skill_id string,"
        " mindset_type string, old_skill_name string",
    )
    events = frame([("S1", 1, "B1", False), ("S1", 2, "B2", False)],
                   "scenario_id string, events_sequence int, skill_id string, archived boolean")
    blocks = frame([("B1", "Empathy")], "id string, title string")
    bank = frame([("b1", "S1", 3), ("b2", "S1", 4)], "id string, scenario_id string, min_passing_score int")
    if "task_rows" in sizes:  # as the build does: the rows written, then numbered
        task_rows = sizes.pop("task_rows")
        rows = stage(marts.scored_rows(stage(small.rows(client, **sizes)), skills, live, events, blocks, bank, **sizes))
        return marts.numbered_scores(rows, task_rows)
    return marts.f_score(small.rows(client, **sizes), skills, live, events, blocks, bank, **sizes)


def test_results_do_not_depend_on_how_large_keys_are_split(frame):
    plain = score(frame, Small(frame), "c2")
    split = score(frame, Small(frame), "c2", task_rows=1, split_rows=1)
    assert Counter(map(tuple, split.collect())) == Counter(map(tuple, plain.collect()))


def test_score(frame):
    out = score(frame, Small(frame), "none").collect()
    assert len(out[0]) == 43
    live = [r for r in out if r.session_id == "s1"]
    # Two teams, two surveyed events, two bank rows; only event 1 is known to the scenario.
    assert len(live) == 8
    assert Counter((r.skill, r.skill_score, r.title, r.domain, r.levent_status) for r in live) == {
        ("Domain", 4.0, "Empathy", "Domain", 1): 4, ("Domain", 3.0, None, "Domain", 0): 4,
    }
    assert sorted(r.attempt for r in live) == list(range(1, 9))
    assert sorted(r.CompetencyAttempt for r in live if r.title) == [1, 2, 3, 4]
    ondemand = [r for r in out if r.session_id == "s2"]
    assert [(r.skill, r.skill_score, r.SessionScore, r.domain, r.title) for r in ondemand] == [
        ("Listening", 2.0, 8.0, None, None)
    ]


def test_copies_share_competency_attempts_but_not_attempts(frame):
    out = [r for r in score(frame, Small(frame), "c2").collect() if r.session_id == "s1"]
    assert Counter(r.client_id for r in out) == {"c2": 8, "x": 8, "y": 8}
    assert max(r.attempt for r in out) == 8
    assert sorted(r.CompetencyAttempt for r in out if r.title) == list(range(1, 13))
    assert {r.client_name for r in out} == {"Two"}
