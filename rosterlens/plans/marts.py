"""The three marts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import session_column
from ..functions.scoring import is_positive, session_status
from ..operators.heavy import KeySketches, Listed, with_route
from ..operators.joins import NULL_SPREAD, SPLIT_ROWS, routed_left_join, split_left_join, smallest_shared
from ..operators.numbering import TASK_ROWS, Numbering, number_within
from ..operators.sets import fan_out_key, tagged_union

# The client whose rows are shown under two further client ids.
FAN_OUT_CLIENT = "55d98b8a-a265-4be5-aa95-e32eeeb4e5d9"
FAN_OUT_COPIES = ("d2f80bc4-6d31-4634-b4a3-338348ebf1dc", "7d3c6a30-b724-4165-b40c-6301fd92f985")


def listed(keys: KeySketches | None, table: str, *on: str) -> Listed | None:
    """The heaviest keys of a table that was written; None leaves finding them to the join."""
    return keys.of(table, *on) if keys else None


def none_large(found: Listed | None, split_rows: int) -> Listed | None:
    """For a table that has some of the keys listed, with as many rows: no large keys if there are none, or not known."""
    return [] if found is not None and all(n <= split_rows for _, n in found) else None


SESSION_COLUMNS = [
    "status", "actual_start_date", "actual_end_date", "start_date", "end_date", "billable", "sub_type",
    "late_canceled", "final_session_sub_status", "session_date",
]


# Rows of a mart that were written on the way to it, sketched by scenario.
WRITTEN_PARTS = {"f_team_sessions_final": "assignments", "f_score": "skills of sessions"}


def dealt_by_scenario(keys: KeySketches | None, *tables: str, split_rows: int = SPLIT_ROWS) -> bool:
    """No scenario has more rows in these tables than a task takes, so that joins may stay with rows dealt by scenario."""
    return all(none_large(listed(keys, t, "scenario_id"), split_rows) is not None for t in tables)


def live_sessions(
    f_live_session: DataFrame,
    m_session_learner: DataFrame,
    m_client_user_role: DataFrame,
    split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
) -> DataFrame:
    """Live sessions, a row per learner. Persons in another role stay, without an id."""
    learners = m_client_user_role.filter(F.col("role") == "learner").select(
        F.col("id").alias("user_role_id"), F.col("user_id").alias("learner_id")
    )
    present = m_session_learner.select(F.col("session_id").alias("id"), "user_role_id")
    sessions = f_live_session.select("id", "scenario_id", *SESSION_COLUMNS)
    return (
        split_left_join(sessions, present, ["id"], split_rows, listed(keys, "m_session_learner", "session_id"))
        .join(learners, "user_role_id", "left")
        .select("id", "scenario_id", *SESSION_COLUMNS, "learner_id")
    )


def with_best_score(sessions: DataFrame, f_live_skills: DataFrame) -> DataFrame:
    """Sessions with the best score of their survey; no mart shows it, so none looks it up."""
    best = (
        f_live_skills.groupBy(F.col(session_column(f_live_skills)).alias("id"))
        .agg(F.max("score").alias("score"))
    )
    return sessions.join(best, "id", "left")


def ondemand_sessions(
    f_ondemand_session: DataFrame, f_session_score: DataFrame, split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
) -> DataFrame:
    """On-demand sessions, a row per score; the columns of live sessions they lack are left out."""
    sessions = f_ondemand_session.select(
        "id",
        "scenario_id",
        session_status(F.col("completed"), F.col("started_at")).alias("status"),
        F.col("started_at").alias("actual_start_date"),
        F.col("ended_at").alias("actual_end_date"),
        F.col("started_at").alias("start_date"),
        F.col("ended_at").alias("end_date"),
        F.col("created_at").alias("session_date"),
        "learner_id",
    )
    scores = f_session_score.select(F.col("sessionid").alias("id"), "score", F.col("id").alias("_score"))
    scored = listed(keys, "f_session_score", "sessionid")
    return split_left_join(sessions, scores, ["id"], split_rows, scored).drop("_score")


def f_sessions_final(
    f_live_session: DataFrame,
    m_session_learner: DataFrame,
    m_client_user_role: DataFrame,
    f_ondemand_session: DataFrame,
    f_session_score: DataFrame,
    d_scenario: DataFrame,
    d_project: DataFrame,
    d_client: DataFrame,
    split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
) -> DataFrame:
    sessions = tagged_union(
        {
            "live": live_sessions(f_live_session, m_session_learner, m_client_user_role, split_rows, keys),
            "ondemand": ondemand_sessions(f_ondemand_session, f_session_score, split_rows, keys),
        },
        "session_type",
    )
    return sessions.join(
        scenario_lookup(d_scenario, d_project, d_client), "scenario_id", "left"
    ).select(
        "id", "scenario_id", *SESSION_COLUMNS, "learner_id", "session_type", "scenario_name",
        "scenario_custom_name", "scenario_project_id", "scenario_client_id", "project_name",
        "client_name",
    )


def scenario_lookup(d_scenario: DataFrame, d_project: DataFrame, d_client: DataFrame) -> DataFrame:
    """Scenarios with the names of their project and client, joined once at the size of the dimension."""
    scenarios = d_scenario.select(
        F.col("id").alias("scenario_id"),
        F.col("name").alias("scenario_name"),
        F.col("name_customized").alias("scenario_custom_name"),
        F.col("project_id").alias("scenario_project_id"),
        F.col("client_id").alias("scenario_client_id"),
        "generation_type",
    )
    projects = d_project.select(
        F.col("id").alias("scenario_project_id"), F.col("name").alias("project_name")
    )
    clients = d_client.select(
        F.col("id").alias("scenario_client_id"),
        F.col("id").alias("found_client_id"),
        F.col("name").alias("client_name"),
        F.col("archived").alias("client_archived"),
        F.col("operated_by").alias("client_operated_by"),
    )
    return scenarios.join(projects, "scenario_project_id", "left").join(
        clients, "scenario_client_id", "left"
    )


def user_clients(d_users: DataFrame, m_user_client: DataFrame, d_client: DataFrame) -> DataFrame:
    """Users with their client, one row each; users without one stay."""
    users = d_users.select(
        F.col("id").alias("user_id"),
        F.col("activation_date").alias("user_activation_date"),
        "first_name", "last_name", "email",
    )
    membership = m_user_client.select(
        F.col("id").alias("user_id"), F.col("client_id").alias("own_client_id")
    )
    clients = d_client.select(
        F.col("id").alias("own_client_id"),
        F.col("id").alias("user_client_id"),
        F.col("name").alias("user_client_name"),
        F.col("archived").alias("user_client_archived"),
        F.col("operated_by").alias("user_client_operated_by"),
    )
    return users.join(membership, "user_id", "left").join(clients, "own_client_id", "left").drop("own_client_id")


def with_roles(
    users: DataFrame, user_id: str, m_client_user_role: DataFrame, split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
) -> DataFrame:
    """A row per role of the user named by `user_id`; rows without a role stay."""
    roles = m_client_user_role.select(
        F.col("user_id").alias(user_id), F.col("id").alias("client_user_role_id"), F.col("role").alias("user_role")
    )
    return split_left_join(users, roles, [user_id], split_rows, listed(keys, "m_client_user_role", "user_id"))


def user_roles(
    d_users: DataFrame,
    m_user_client: DataFrame,
    d_client: DataFrame,
    m_client_user_role: DataFrame,
    split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
) -> DataFrame:
    """Users with their client, a row per role; users without either stay."""
    return with_roles(user_clients(d_users, m_user_client, d_client), "user_id", m_client_user_role, split_rows, keys)


def current_team_scenarios(
    d_users: DataFrame,
    m_client_user_role: DataFrame,
    m_team_member: DataFrame,
    m_scenario_team: DataFrame,
    split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
) -> DataFrame:
    """What each user is assigned to now: (user_id, team_id, scenario_id), users without any kept."""
    roles = m_client_user_role.select("user_id", F.col("id").alias("user_role_id"))
    members = m_team_member.select("user_role_id", "team_id")
    users = split_left_join(
        d_users.select(F.col("id").alias("user_id")), roles, ["user_id"], split_rows,
        listed(keys, "m_client_user_role", "user_id"),
    )
    teams = (
        split_left_join(
            users, members, ["user_role_id"], split_rows, listed(keys, "m_team_member", "user_role_id")
        ).select("user_id", "team_id").distinct()
    )
    # Both sides have one row per pair, so the result needs no distinct.
    return split_left_join(
        teams, m_scenario_team.select("team_id", "scenario_id"), ["team_id"], split_rows,
        listed(keys, "m_scenario_team", "team_id"),
    )


def all_team_scenarios(
    current: DataFrame,
    f_sessions_final: DataFrame,
    m_client_user_role: DataFrame,
    raw_scenario_team: DataFrame,
    raw_team_member: DataFrame,
) -> DataFrame:
    """Current assignments plus (user, scenario) pairs that only sessions show.

    Pairs without a current row are the historical ones. Only for those a team is looked up, in the raw
    feeds on purpose, so that ended memberships count; among several the smallest id is taken.
    """
    played = (
        f_sessions_final.select(F.col("learner_id").alias("user_id"), "scenario_id").dropna().distinct()
    )
    past = played.join(current.select("user_id", "scenario_id"), ["user_id", "scenario_id"], "left_anti")

    role_users = m_client_user_role.select(F.col("id").alias("user_role_id"), "user_id")
    user_teams = raw_team_member.select("user_role_id", "team_id").distinct().join(
        role_users, "user_role_id"
    )
    chosen = smallest_shared(past, user_teams, raw_scenario_team, "user_id", "scenario_id", "team_id")
    return current.select("user_id", "team_id", "scenario_id").unionByName(
        past.join(chosen, ["user_id", "scenario_id"], "left").select("user_id", "team_id", "scenario_id")
    )


def team_sessions(
    d_users: DataFrame,
    m_user_client: DataFrame,
    d_client: DataFrame,
    m_client_user_role: DataFrame,
    m_team_member: DataFrame,
    d_team: DataFrame,
    m_scenario_team: DataFrame,
    f_sessions_final: DataFrame,
    d_scenario: DataFrame,
    d_project: DataFrame,
    raw_scenario_team: DataFrame,
    raw_team_member: DataFrame,
    split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
    written: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """A row per user, role, team, scenario and session; assignments without a session stay.

    `written` is what becomes of the assignments, as ids: a staged table, or a plan as it is.
    """
    current = current_team_scenarios(
        d_users, m_client_user_role, m_team_member, m_scenario_team, split_rows, keys
    )
    assigned = written(all_team_scenarios(
        current, f_sessions_final, m_client_user_role, raw_scenario_team, raw_team_member
    ))
    sessions = f_sessions_final.select(
        F.col("learner_id").alias("user_id"), "scenario_id", F.col("id").alias("session_id"),
        *SESSION_COLUMNS, "session_type",
    )
    teams = d_team.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    people = with_roles(user_clients(d_users, m_user_client, d_client), "user_id", m_client_user_role, split_rows, keys)
    # Assignments are fewer and narrower than sessions, so they meet the dimensions first and every
    # session is shuffled once, for the last join. Roles are met at the size of the users, and teams while rows are ids only.
    # Scenarios come last, by keys that are among those of the sessions: rows dealt for one can stay for the other. Rows
    # without a scenario match nothing, and `_deal` spreads them. It is 0 for all others, by a hash, as a constant would not be dealt by.
    known = split_left_join(
        assigned.join(teams, "team_id", "left"), people, ["user_id"], split_rows,
        none_large(listed(keys, "m_client_user_role", "user_id"), split_rows),
    ).withColumn("_deal", F.when(F.col("scenario_id").isNull(), F.pmod(F.xxhash64("user_id", "team_id"), F.lit(NULL_SPREAD)).cast("int")).otherwise(0))
    dealt = F.pmod(F.hash("scenario_id"), F.lit(1))
    known = known.join(
        scenario_lookup(d_scenario, d_project, d_client).withColumn("_deal", dealt), ["scenario_id", "_deal"], "left")
    joined = split_left_join(
        known, sessions.withColumn("_deal", dealt), ["user_id", "scenario_id", "_deal"], split_rows,
        with_route({"0": listed(keys, "f_sessions_final", "learner_id", "scenario_id")}),
    )
    return joined.select(
        F.coalesce("found_client_id", "user_client_id").alias("client_id"),
        "user_id", "user_activation_date", "first_name", "last_name", "email",
        F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
        F.coalesce("client_name", "user_client_name").alias("client_name"),
        F.coalesce("client_archived", "user_client_archived").alias("client_archived"),
        F.coalesce("client_operated_by", "user_client_operated_by").alias("client_operated_by"),
        "user_role", "client_user_role_id", "team_id", "team_name", "scenario_id", "scenario_name",
        F.col("scenario_custom_name").alias("customized_scenario_name"),
        F.col("scenario_project_id").alias("project_id"),
        "project_name", "session_id", *SESSION_COLUMNS, "session_type",
        F.col("generation_type").alias("scenario_generation_type"),
    )


def f_team_sessions_final(
    d_users: DataFrame,
    m_user_client: DataFrame,
    d_client: DataFrame,
    m_client_user_role: DataFrame,
    m_team_member: DataFrame,
    d_team: DataFrame,
    m_scenario_team: DataFrame,
    f_sessions_final: DataFrame,
    d_scenario: DataFrame,
    d_project: DataFrame,
    raw_scenario_team: DataFrame,
    raw_team_member: DataFrame,
    fan_out_client: str = FAN_OUT_CLIENT,
    fan_out_copies: Sequence[str] = FAN_OUT_COPIES,
    split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
    written: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    base = team_sessions(
        d_users, m_user_client, d_client, m_client_user_role, m_team_member, d_team, m_scenario_team,
        f_sessions_final, d_scenario, d_project, raw_scenario_team, raw_team_member, split_rows, keys, written,
    )
    return fan_out_key(base, "client_id", fan_out_client, fan_out_copies)


def learner_rows(f_team_sessions_final: DataFrame) -> DataFrame:
    """The rows that are scored. Neither names nor addresses are in the mart, so they do not travel."""
    return f_team_sessions_final.filter(
        (F.col("user_role") == "learner") & (F.col("scenario_generation_type") == 1)
    ).select(*[c for c in f_team_sessions_final.columns if c in {*SCORE_COLUMNS, "scenario_generation_type"}])


def scored_rows(
    f_team_sessions_final: DataFrame,
    f_ondemand_skills: DataFrame,
    f_live_skills: DataFrame,
    d_events: DataFrame,
    d_building_blocks: DataFrame,
    d_scenario_bank_event_scoring: DataFrame,
    split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
    written: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Learner rows of generated scenarios with their skill scores, before attempts are numbered.

    `written` is what becomes of the rows between the lookups by session and those by scenario: a staged table, or a plan as it is.
    """
    ondemand = f_ondemand_skills.select(
        F.col("sessionid").alias("session_id"), "skill", "skill_score", "SessionScore"
    )
    live = f_live_skills.select(
        F.col(session_column(f_live_skills)).alias("session_id"),
        F.col("skill_name").alias("domain"),
        F.col("skill_score").alias("live_score"),
        F.col("score").alias("live_session_score"),
        "event_number", "skill_id", "mindset_type", "old_skill_name",
    )
    events = d_events.filter(~F.col("archived")).select(
        "scenario_id",
        F.col("events_sequence").alias("event_number"),
        "events_sequence",
        F.col("skill_id").alias("event_skill_id"),
    )
    blocks = d_building_blocks.select(F.col("id").alias("event_skill_id"), "title")
    event_keys = events
    events = events.join(blocks, "event_skill_id", "left")
    bank = d_scenario_bank_event_scoring.select(
        "scenario_id", F.col("id").alias("scenario_bank_id"), "min_passing_score"
    )
    rows = routed_left_join(
        learner_rows(f_team_sessions_final).drop("scenario_generation_type"), "session_id", "session_type", {"ondemand": ondemand, "live": live}, split_rows,
        {
            "ondemand": listed(keys, "f_ondemand_skills", "sessionid"),
            "live": listed(keys, "f_live_skills", session_column(f_live_skills)),
        },
    )
    rows = written(rows)
    # Banks before events: rows dealt by scenario can meet both where they are, so banks are not broadcast.
    if dealt_by_scenario(keys, WRITTEN_PARTS["f_score"]):
        bank = bank.hint("merge")
    rows = split_left_join(
        rows, bank, ["scenario_id"], split_rows, listed(keys, "d_scenario_bank_event_scoring", "scenario_id")
    )
    # Events are matched on the live event number; rows without one find none and stay.
    rows = split_left_join(rows, events, ["scenario_id", "event_number"], split_rows, event_keys)
    return rows.select(
        "*",
        F.col("skill").alias("ondemand_skill"),
    ).withColumns({
        "skill": F.coalesce("skill", "domain"),
        "skill_score": F.coalesce("skill_score", F.col("live_score").cast("double")),
        "SessionScore": F.coalesce("SessionScore", F.col("live_session_score").cast("double")),
        "competency": F.coalesce("ondemand_skill", "title"),
        "levent_status": is_positive(F.col("mindset_type")),
    })


# What tells apart rows with the same start, so that numbers do not depend on the data's layout.
ATTEMPT_TIES = [
    "session_id", "client_id", "client_user_role_id", "team_id", "scenario_id", "session_type",
    "event_number", "skill", "skill_score", "SessionScore", "skill_id", "old_skill_name",
    "mindset_type", "event_skill_id", "scenario_bank_id",
]
SCORE_COLUMNS = [
    "client_id", "user_id", "user_activation_date", "client_name", "client_archived",
    "client_operated_by", "user_role", "client_user_role_id", "team_id", "team_name", "scenario_id",
    "scenario_name", "customized_scenario_name", "project_id", "project_name", "session_id", "status",
    "actual_start_date", "actual_end_date", "start_date", "end_date", "billable", "sub_type",
    "late_canceled", "final_session_sub_status", "session_date", "session_type", "skill",
    "skill_score", "SessionScore", "attempt", "event_number", "events_sequence", "skill_id",
    "event_skill_id", "scenario_bank_id", "min_passing_score", "domain", "title", "mindset_type",
    "levent_status", "old_skill_name", "CompetencyAttempt",
]


def numbered_scores(rows: DataFrame, task_rows: int = TASK_ROWS, heavy: Listed | None = None) -> DataFrame:
    """The score mart from its rows; `heavy` lists the users with the most of them, as for `number_rows`."""
    order = ["start_date", *ATTEMPT_TIES]
    # A role belongs to one user, so the groups of both numberings lie within a user. Rows alike in
    # everything else differ in their attempt, which makes the second order as good as total.
    numbered = number_within(
        rows,
        "user_id",
        [
            Numbering(["client_id", "user_id", "scenario_id", "skill", "session_type"], order, "attempt"),
            Numbering(["client_user_role_id", "competency"], [*order, "attempt"], "CompetencyAttempt"),
        ],
        task_rows, heavy,
    )
    return numbered.select(*SCORE_COLUMNS)


def f_score(
    f_team_sessions_final: DataFrame,
    f_ondemand_skills: DataFrame,
    f_live_skills: DataFrame,
    d_events: DataFrame,
    d_building_blocks: DataFrame,
    d_scenario_bank_event_scoring: DataFrame,
    split_rows: int = SPLIT_ROWS,
    keys: KeySketches | None = None,
) -> DataFrame:
    """As one plan, with plain windows; `plans/build.py: make` writes the rows first and numbers large users by ranges."""
    rows = scored_rows(
        f_team_sessions_final, f_ondemand_skills, f_live_skills, d_events, d_building_blocks,
        d_scenario_bank_event_scoring, split_rows, keys,
    )
    return numbered_scores(rows, heavy=[])
