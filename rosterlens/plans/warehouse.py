"""The warehouse models.

Most of them are current-row selections that differ in key, order and what is dropped afterwards.
Those that pass the raw row through keep the rank column, as the tables always had it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, session_column
from ..functions.scoring import passed, proficiency
from ..functions.text import html_clean, not_blank, parse_day, strip_p, trim_ws
from ..operators.cdc import KEEP_MARKED_LIVE, KEEP_UNMARKED, latest_row, undeleted_groups
from ..operators.heavy import KeySketches, Listed
from ..operators.joins import SPLIT_ROWS, split_left_join
from ..operators.numbering import TASK_ROWS, number_rows
from ..operators.reshape import json_entries, pivot_entries, unpivot_slots

REVISION = [("modify_revision", "desc")]
VERSION = [("version", "desc")]
OP = [("op", "desc")]
# Scores keep the row created first.
FIRST_CREATED = [("createdat", "asc"), ("updatedat", "desc")]
NOT_ARCHIVED = "archived = false"


# Dimensions


def d_client(raw_client: DataFrame) -> DataFrame:
    return latest_row(raw_client, ["id"], REVISION, keep=NOT_ARCHIVED)


def d_users(raw_users: DataFrame) -> DataFrame:
    return latest_row(raw_users, ["id"], REVISION, keep=NOT_ARCHIVED)


def d_team(raw_team: DataFrame) -> DataFrame:
    return latest_row(raw_team, ["id"], REVISION)


def d_industry(raw_industry: DataFrame) -> DataFrame:
    return latest_row(raw_industry, ["id"], REVISION)


def d_project(raw_project: DataFrame) -> DataFrame:
    return latest_row(raw_project, ["id"], REVISION, keep=NOT_ARCHIVED)


def d_scenario(raw_scenario: DataFrame) -> DataFrame:
    return latest_row(raw_scenario, ["id"], REVISION, keep=NOT_ARCHIVED)


def d_building_blocks(raw_building_blocks: DataFrame) -> DataFrame:
    current = latest_row(raw_building_blocks, ["id"], VERSION, keep=NOT_ARCHIVED)
    return current.select(
        "id",
        html_clean(F.col("title")).alias("title"),
        html_clean(F.col("description")).alias("description"),
        "building_block_type", "type", "level", "licensee_id", "version",
    )


def d_events(raw_events: DataFrame) -> DataFrame:
    return latest_row(raw_events, ["id"], VERSION, keep=NOT_ARCHIVED)


def d_scenario_goals(raw_scenario_goals: DataFrame) -> DataFrame:
    return latest_row(raw_scenario_goals, ["scenario_id", "goal_index"], OP, keep=KEEP_UNMARKED)


def d_scenario_bank_event_scoring(raw_scenario_bank_event_scoring: DataFrame) -> DataFrame:
    current = latest_row(raw_scenario_bank_event_scoring, ["id"], VERSION)
    return current.select(
        "id",
        "scenario_id",
        html_clean(F.col("synopsis")).alias("synopsis"),
        "min_passing_score", "event_count", "passing_score_percentage",
        html_clean(F.col("opportunity_development")).alias("opportunity_development"),
        html_clean(F.col("successful_assessment")).alias("successful_assessment"),
        "origin_id", "version",
    )


# Output name and the dotted name it is read from.
REPORT_COLUMNS = {
    "op": "op",
    "id": "_id",
    "session_id": "session_learner_report.sessionid",
    "simfeedback_question_id": "session_learner_report.simfeedback.questionid",
    "simfeedback_question_text": "session_learner_report.simfeedback.questiontext",
    "simfeedback_answer_text": "session_learner_report.simfeedback.answertext",
    "simfeedback_selected_answer_number": "session_learner_report.simfeedback.selectedanswernumber",
    "strategies": "array_session_learner_report.strategies",
    "pre_simulation_confidence": "session_learner_report.presimulationconfidence",
    "pre_conf_question_id": "session_learner_report.presimulationconfidence.questionid",
    "pre_conf_question_text": "session_learner_report.presimulationconfidence.questiontext",
    "pre_conf_answer_text": "session_learner_report.presimulationconfidence.answertext",
    "pre_conf_selected_answer_number":
        "session_learner_report.presimulationconfidence.selectedanswernumber",
    "post_conf_question_id": "session_learner_report.postsimulationconfidence.questionid",
    "post_conf_question_text": "session_learner_report.postsimulationconfidence.questiontext",
    "post_conf_answer_text": "session_learner_report.postsimulationconfidence.answertext",
    "post_conf_selected_answer_number":
        "session_learner_report.postsimulationconfidence.selectedanswernumber",
    "oid_id": "oid__id",
}


def d_learner_confidence(raw_session_learner_report: DataFrame) -> DataFrame:
    flat = raw_session_learner_report.select(
        *[col(source).alias(name) for name, source in REPORT_COLUMNS.items()]
    )
    return latest_row(flat, ["session_id"], OP)


# The survey's questions in output order, and the fields of an answer.
QUESTION_IDS = [
    "Q1", "Q2", "Q3_1", "Q3_2", "Q3_3", "Q3_4", "Q3_5", "Q4", "Q5", "Q6", "Q7", "Q8", "Q9", "Q13", "Q14",
    "Q17", "Q18", "Q19", "Q20", "Q21", "Q22", "Q23", "Q24", "Q62", "Q26",
]
ANSWER_FIELDS = ["questionText", "answerText", "selectedAnswerNumber"]


def survey_answers(raw_post_simulation: DataFrame, session_id: str | None = None) -> DataFrame:
    """The latest survey per session with its answers as an array of cleaned structs."""
    source = session_id or session_column(raw_post_simulation, "POST_SIMULATION.")
    session = source.split(".")[-1].lower()
    surveys = raw_post_simulation.withColumn(session, trim_ws(col(source))).filter(
        not_blank(col(session))
    )
    surveys = surveys.withColumn("recordeddate", parse_day(col("POST_SIMULATION.recordedDate")))
    current = latest_row(surveys, [session], [("recordeddate", "desc")], keep_rank=False)
    parsed = current.select(
        session,
        trim_ws(col("POST_SIMULATION.userid")).alias("userid"),
        col("POST_SIMULATION.webportal").alias("webportal"),
        col("POST_SIMULATION.finished").alias("finished"),
        "recordeddate",
        json_entries(
            col("array_POST_SIMULATION.questions"), ["questionId", *ANSWER_FIELDS]
        ).alias("answers"),
    )
    clean = F.transform(
        F.filter("answers", lambda a: a["questionId"].isin(*QUESTION_IDS)),
        lambda a: F.struct(
            a["questionId"].alias("questionId"),
            html_clean(a["questionText"]).alias("questionText"),
            html_clean(a["answerText"]).alias("answerText"),
            trim_ws(a["selectedAnswerNumber"]).alias("selectedAnswerNumber"),
        ),
    )
    return parsed.withColumn("answers", clean)


def d_post_simulation(raw_post_simulation: DataFrame, session_id: str | None = None) -> DataFrame:
    answers = survey_answers(raw_post_simulation, session_id)
    carry = [c for c in answers.columns if c != "answers"]
    return pivot_entries(answers, "answers", "questionId", QUESTION_IDS, ANSWER_FIELDS, carry)


# Facts


def f_live_session(raw_session: DataFrame) -> DataFrame:
    return latest_row(raw_session, ["id"], REVISION).withColumn(
        "session_date", F.col("start_date").cast("date")
    )


def f_ondemand_session(raw_ondemand_session: DataFrame) -> DataFrame:
    return latest_row(
        raw_ondemand_session,
        ["id"],
        [("ended_at", "desc"), ("started_at", "desc"), ("created_at", "desc")],
    )


def f_ondemand_session_event(raw_ondemand_session_event: DataFrame) -> DataFrame:
    return raw_ondemand_session_event


def f_session_score(raw_session_score: DataFrame) -> DataFrame:
    narrow = raw_session_score.select(
        "id", "createdat", "updatedat", "deletedat", "sessionid", "score", "goaldescription", "userid",
        "clientid",
    )
    return latest_row(narrow, ["id"], FIRST_CREATED)


def f_skill_score(raw_skill_score: DataFrame) -> DataFrame:
    narrow = raw_skill_score.select(
        "id", "createdat", "updatedat", "deletedat", "skillid", "skill", "skilldescription",
        "capability", "capabilitydescription", "pillar", "score", "sessionscoreid",
    )
    return latest_row(narrow, ["id"], FIRST_CREATED)


def f_skill_domain_mapping(raw_skill_domain_mapping: DataFrame) -> DataFrame:
    return latest_row(
        raw_skill_domain_mapping, ["skill_id"], [("operated_on", "desc"), ("op", "desc")],
        keep=f"({KEEP_UNMARKED}) and {NOT_ARCHIVED}",
    )


def f_skill_domain_name(
    f_live_skills: DataFrame, f_skill_domain_mapping: DataFrame, d_building_blocks: DataFrame
) -> DataFrame:
    mapping = f_skill_domain_mapping.select("skill_id", "domain_id")
    block = d_building_blocks.select(
        F.col("id").alias("domain_id"), F.col("title").alias("domain_name")
    )
    # Both lookups have one row per key, so duplicates can go before them.
    return (
        f_live_skills.select("skill_id", "skill_name").distinct()
        .join(mapping, "skill_id", "left")
        .join(block, "domain_id", "left")
        .select("skill_id", "domain_id", "skill_name", "domain_name")
    )


def f_events_assessment(raw_events_assessment: DataFrame) -> DataFrame:
    return latest_row(raw_events_assessment, ["id"], VERSION, keep=NOT_ARCHIVED)


def f_events_mindset(raw_events_mindset: DataFrame) -> DataFrame:
    return latest_row(raw_events_mindset, ["id"], VERSION)


def f_session_insights_service(raw_session_insights_service: DataFrame) -> DataFrame:
    return latest_row(raw_session_insights_service, ["id"], OP)


SLOTS = 5


def survey_events(raw_sim_feedback: DataFrame, session_id: str | None = None) -> DataFrame:
    """The latest survey per session, a row per filled slot. `session_id` names its column if several could be."""
    source = session_id or session_column(raw_sim_feedback, "SIM_FEEDBACK.")
    session = source.split(".")[-1].lower()
    surveys = raw_sim_feedback.withColumn(session, trim_ws(col(source))).filter(not_blank(col(session)))
    # Ranking and output both use the trimmed date.
    surveys = surveys.withColumn("recordeddate", parse_day(col("SIM_FEEDBACK.recordedDate")))
    current = latest_row(
        surveys, [session], [("recordeddate", "desc"), ("op", "desc")], keep_rank=False
    )
    plain = ["webportal", "finished", "generationType", "score"]
    carried = {"strengthAssessmentId": "strengthassessmentid",
               "opportunitiesAssessmentId": "opportunitiesassessmentid"}
    narrow = current.select(
        session,
        F.col("recordeddate").cast("date").alias("recordeddate"),
        *[col(f"SIM_FEEDBACK.{c}").alias(c) for c in plain],
        *[col(f"SIM_FEEDBACK.{c}").alias(name) for name, c in carried.items()],
        *[
            col(f"SIM_FEEDBACK.{c}").alias(c)
            for n in range(1, SLOTS + 1)
            for c in (f"event{n}skillid", f"event{n}skillname", f"selectedevent{n}mindsetid")
        ],
    )
    slots = [
        {"skill_id": f"event{n}skillid", "old_skill_name": f"event{n}skillname",
         "mindset_id": f"selectedevent{n}mindsetid"}
        for n in range(1, SLOTS + 1)
    ]
    events = unpivot_slots(
        narrow,
        [session, "webportal", "finished", "recordeddate", "generationType", "score", *carried],
        slots, number="event_number", require="skill_id",
    )
    return events.withColumn("old_skill_name", strip_p(F.col("old_skill_name")))


def f_live_skills(
    raw_sim_feedback: DataFrame,
    m_skill_score_mindset: DataFrame,
    f_skill_domain_mapping: DataFrame,
    d_building_blocks: DataFrame,
    f_events_mindset: DataFrame,
    split_rows: int = SPLIT_ROWS,
    session_id: str | None = None,
    keys: KeySketches | None = None,
) -> DataFrame:
    # Each lookup is put together at the size of its dimension: one row per skill, one per mindset.
    domains = f_skill_domain_mapping.select("skill_id", "domain_id").join(
        d_building_blocks.select(
            F.col("id").alias("domain_id"),
            strip_p(F.col("title")).alias("skill_name"),
            "building_block_type", "level",
        ),
        "domain_id", "left",
    )
    competencies = f_events_mindset.select(
        F.col("id").alias("mindset_id"), F.col("mindset_id").alias("block_id")
    ).join(
        d_building_blocks.select(
            F.col("id").alias("block_id"),
            F.col("id").alias("CompetencyID"),
            F.col("title").alias("mindset_score"),
            F.col("type").alias("mindset_type"),
        ),
        "block_id", "left",
    )
    # No column of the repeats is used. They are here for the rows they repeat, and meet the competencies, which have the
    # same key, at the size of the dimension, so that events are shuffled once for both.
    repeats = m_skill_score_mindset.select("mindset_id", "events_mindset_id")
    mindsets = repeats.join(competencies, "mindset_id", "full").drop("events_mindset_id")
    listed = keys.of("m_skill_score_mindset", "mindset_id") if keys else None
    events = split_left_join(survey_events(raw_sim_feedback, session_id), mindsets, ["mindset_id"], split_rows, listed)
    session = session_column(events)
    return events.join(domains, "skill_id", "left").select(
        session, "webportal", "finished", "recordeddate", "generationType",
        passed(F.col("score")).alias("score"),
        "strengthAssessmentId", "opportunitiesAssessmentId", "event_number", "skill_id",
        "old_skill_name", "CompetencyID", "skill_name", "building_block_type", "level", "domain_id",
        "mindset_id", "mindset_score", "mindset_type",
        proficiency(F.col("mindset_score"), F.col("mindset_type")).alias("skill_score"),
    )


def ondemand_skill_scores(f_skill_score: DataFrame, f_session_score: DataFrame) -> DataFrame:
    """Skill scores with the session they belong to; scores without one stay."""
    sessions = f_session_score.select(
        F.col("id").alias("sessionscoreid"), "sessionid", F.col("score").alias("SessionScore")
    )
    skills = f_skill_score.select(
        F.col("id").alias("skill_score_id"), "skill", F.col("score").alias("skill_score"),
        "sessionscoreid",
    )
    return skills.join(sessions, "sessionscoreid", "left").select(
        "sessionid", "skill", "skill_score", "SessionScore", "skill_score_id"
    )


def ranked_skills(scores: DataFrame, task_rows: int = TASK_ROWS, heavy: Listed | None = None) -> DataFrame:
    """Skills ranked within their session; all scores without a session are one group, which may be large."""
    return number_rows(scores, ["sessionid"], ["skill", "skill_score_id"], "rn", task_rows, heavy).drop("skill_score_id")


def f_ondemand_skills(f_skill_score: DataFrame, f_session_score: DataFrame) -> DataFrame:
    """As one plan, with a plain window; `plans/build.py: make` writes the scores first and ranks large sessions by ranges."""
    return ranked_skills(ondemand_skill_scores(f_skill_score, f_session_score), heavy=[])


# Bridges


def m_user_client(raw_client_user: DataFrame) -> DataFrame:
    current = latest_row(raw_client_user, ["id"], OP, keep=NOT_ARCHIVED)
    return current.select("op", "id", "client_id", "archived")


def m_client_user_role(raw_client_user_role: DataFrame) -> DataFrame:
    return latest_row(raw_client_user_role, ["id"], VERSION)


def m_team_member(raw_team_member: DataFrame) -> DataFrame:
    # Ascending: a delete wins over everything else.
    return latest_row(
        raw_team_member, ["team_id", "user_role_id"], [("op", "asc")], keep=KEEP_MARKED_LIVE
    )


def m_scenario_team(raw_scenario_team: DataFrame) -> DataFrame:
    return latest_row(raw_scenario_team, ["scenario_id", "team_id"], OP)


def m_scenario_building_block(raw_scenario_building_block: DataFrame) -> DataFrame:
    return latest_row(raw_scenario_building_block, ["id"], [("operated_on", "desc")])


def m_session_learner(raw_session_learner: DataFrame) -> DataFrame:
    return undeleted_groups(raw_session_learner, ["session_id", "user_role_id"])


def m_skill_score_mindset(f_events_mindset: DataFrame, d_building_blocks: DataFrame) -> DataFrame:
    blocks = d_building_blocks.select(F.col("id").alias("mindset_id"), "type")
    return (
        f_events_mindset.select(F.col("id").alias("events_mindset_id"), "mindset_id")
        .join(blocks, "mindset_id")
        .select("events_mindset_id", "mindset_id", "type")
    )
