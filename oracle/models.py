"""The models as SQL over the shaped feeds, written without looking at how Spark gets there."""

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
ENTITIES = "nbsp|rsquo|rdquo|ldquo|lsquo|ndash|hellip"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return f"regexp_replace({trim(x)}, '<[^>]*>|&({ENTITIES});', '', 'g')"


def paragraphs(x: str) -> str:
    return trim(f"regexp_replace({x}, '</?p[^>]*>', '', 'g')")


def first(raw: str, keys: str, order: str, keep: str = "true") -> str:
    """The first row per key; `keep` is asked of the chosen rows."""
    return f"""
        SELECT * FROM (SELECT DISTINCT ON ({keys}) *, 1::BIGINT AS row_number FROM {raw} ORDER BY {keys}, {order})
        WHERE {keep}"""


LIVE = "NOT archived"
REPORT_GROUPS = [
    ("simfeedback", "sf"), ("pre_conf", "pre"), ("post_conf", "post"),
]


def _report() -> str:
    columns = []
    for name, short in REPORT_GROUPS:
        for out, field in (("question_id", "questionid"), ("question_text", "questiontext"),
                           ("answer_text", "answertext")):
            columns.append(f"'{short} {field} ' || o_orderpriority || rev AS {name}_{out}")
        columns.append(f"((o_orderkey + rev) % 5)::VARCHAR AS {name}_selected_answer_number")
    return f"""
        SELECT op, 'LR' || o_orderkey || '-' || rev AS id, 'L' || o_orderkey AS session_id,
               '[' || o_orderstatus || ']' AS strategies, o_orderpriority AS pre_simulation_confidence,
               {", ".join(columns)}, 'oid' || o_orderkey AS oid_id, 1::BIGINT AS row_number
        FROM raw_session_learner_report r
        WHERE op = (SELECT max(op) FROM raw_session_learner_report x WHERE x.o_orderkey = r.o_orderkey)"""


QUESTIONS = [
    "Q1", "Q2", "Q3_1", "Q3_2", "Q3_3", "Q3_4", "Q3_5", "Q4", "Q5", "Q6", "Q7", "Q8", "Q9", "Q13", "Q14",
    "Q17", "Q18", "Q19", "Q20", "Q21", "Q22", "Q23", "Q24", "Q26", "Q62",
]
LISTED = ", ".join(f"'{q}'" for q in QUESTIONS)
PIVOT = ", ".join(
    f"max({source}) FILTER (WHERE qid = '{q}') AS {q}_{name}"
    for q in QUESTIONS
    for source, name in (("question", "questionText"), ("answer", "answerText"),
                         ("num", "selectedAnswerNumber"))
)
SESSION = ("status, actual_start_date, actual_end_date, start_date, end_date, billable, sub_type, "
           "late_canceled, final_session_sub_status, session_date")
TIES = ("start_date, session_id, client_id, client_user_role_id, team_id, scenario_id, session_type, "
        "event_number, skill, skill_score, SessionScore, skill_id, old_skill_name, mindset_type, "
        "event_skill_id, scenario_bank_id")

MODELS = {
    "d_client": first("raw_client", "id", "modify_revision DESC", LIVE),
    "d_users": first("raw_users", "id", "modify_revision DESC", LIVE),
    "d_team": first("raw_team", "id", "modify_revision DESC"),
    "d_industry": first("raw_industry", "id", "modify_revision DESC"),
    "d_project": first("raw_project", "id", "modify_revision DESC", LIVE),
    "d_scenario": first("raw_scenario", "id", "modify_revision DESC", LIVE),
    "d_building_blocks": f"""
        SELECT id, {clean("title")} AS title, {clean("description")} AS description,
               building_block_type, type, level, licensee_id, version
        FROM ({first("raw_building_blocks", "id", "version DESC", LIVE)})""",
    "d_events": first("raw_events", "id", "version DESC", LIVE),
    "d_scenario_goals": first(
        "raw_scenario_goals", "scenario_id, goal_index", "op DESC", "op IS DISTINCT FROM 'D'"),
    "d_scenario_bank_event_scoring": f"""
        SELECT id, scenario_id, {clean("synopsis")} AS synopsis, min_passing_score, event_count,
               passing_score_percentage, {clean("opportunity_development")} AS opportunity_development,
               {clean("successful_assessment")} AS successful_assessment, origin_id, version
        FROM ({first("raw_scenario_bank_event_scoring", "id", "version DESC")})""",
    "d_learner_confidence": _report(),
    "exploded_answers": f"""
        SELECT sessionid, userid, webportal, finished, recordeddate, a.id AS qid,
               {clean("a.question")} AS question, {clean("a.answer")} AS answer, {trim("a.num")} AS num
        FROM (SELECT session AS sessionid, userid, webportal, finished, recordeddate,
                     unnest(answers) AS a
              FROM raw_post_simulation r
              WHERE recordeddate = (SELECT max(recordeddate) FROM raw_post_simulation x
                                    WHERE x.session = r.session))
        WHERE a.id IN ({LISTED})""",
    "d_post_simulation": f"""
        SELECT sessionid, userid, webportal, finished, recordeddate, {PIVOT}
        FROM exploded_answers GROUP BY ALL""",
    "f_live_session": f"""
        SELECT *, start_date::DATE AS session_date
        FROM ({first("raw_session", "id", "modify_revision DESC")})""",
    "f_ondemand_session": first(
        "raw_ondemand_session", "id", "ended_at DESC, started_at DESC, created_at DESC"),
    "f_ondemand_session_event": "SELECT * FROM raw_ondemand_session_event",
    "f_session_score": first("raw_session_score", "id", "createdat, updatedat DESC"),
    "f_skill_score": first("raw_skill_score", "id", "createdat, updatedat DESC"),
    "f_skill_domain_mapping": first(
        "raw_skill_domain_mapping", "skill_id", "operated_on DESC, op DESC",
        "op IS DISTINCT FROM 'D' AND NOT archived"),
    "f_events_assessment": first("raw_events_assessment", "id", "version DESC", LIVE),
    "f_events_mindset": first("raw_events_mindset", "id", "version DESC"),
    "f_session_insights_service": first("raw_session_insights_service", "id", "op DESC"),
    "m_user_client": f"""
        SELECT op, id, client_id, archived FROM ({first("raw_client_user", "id", "op DESC", LIVE)})""",
    "m_client_user_role": first("raw_client_user_role", "id", "version DESC"),
    "m_team_member": first("raw_team_member", "team_id, user_role_id", "op", "op <> 'D'"),
    "m_scenario_team": first("raw_scenario_team", "scenario_id, team_id", "op DESC"),
    "m_scenario_building_block": first("raw_scenario_building_block", "id", "operated_on DESC"),
    "m_session_learner": """
        SELECT session_id, user_role_id, '0' AS has_d_value FROM raw_session_learner
        GROUP BY session_id, user_role_id HAVING NOT coalesce(bool_or(op = 'D'), false)""",
    "m_skill_score_mindset": """
        SELECT m.id AS events_mindset_id, m.mindset_id, b.type
        FROM f_events_mindset m JOIN d_building_blocks b ON b.id = m.mindset_id""",
    "survey_events": f"""
        SELECT sessionid, webportal, finished, recordeddate::DATE AS recordeddate, generationType, score,
               strengthAssessmentId, opportunitiesAssessmentId, s.n AS event_number, s.skill AS skill_id,
               {paragraphs("s.name")} AS old_skill_name, s.mindset AS mindset_id
        FROM (SELECT *, unnest(slots) AS s
              FROM (SELECT DISTINCT ON (sessionid) *
                    FROM (SELECT *, {trim("session")} AS sessionid,
                                 strptime({trim("recorded")}, '%Y-%m-%d') AS recordeddate
                          FROM raw_sim_feedback)
                    WHERE sessionid <> ''
                    ORDER BY sessionid, recordeddate DESC, op DESC))
        WHERE {trim("s.skill")} <> ''""",
    "f_live_skills": f"""
        SELECT e.sessionid, e.webportal, e.finished, e.recordeddate, e.generationType,
               CASE WHEN e.score IS NOT NULL THEN (e.score >= 3)::INTEGER END AS score,
               e.strengthAssessmentId, e.opportunitiesAssessmentId, e.event_number::INTEGER AS event_number,
               e.skill_id, e.old_skill_name, c.id AS CompetencyID, {paragraphs("d.title")} AS skill_name,
               d.building_block_type, d.level, m.domain_id, e.mindset_id, c.title AS mindset_score,
               c.type AS mindset_type,
               CASE coalesce(c.title, 'Novice') WHEN 'Strong' THEN 4 WHEN 'Competent' THEN 3
                    WHEN 'Emerging' THEN 2 WHEN 'Novice' THEN 1
                    ELSE CASE c.type WHEN 'Positive' THEN 3 WHEN 'Derailing' THEN 1 ELSE 0 END
               END AS skill_score
        FROM survey_events e
        LEFT JOIN m_skill_score_mindset x ON x.mindset_id = e.mindset_id
        LEFT JOIN f_skill_domain_mapping m ON m.skill_id = e.skill_id
        LEFT JOIN d_building_blocks d ON d.id = m.domain_id
        LEFT JOIN f_events_mindset v ON v.id = e.mindset_id
        LEFT JOIN d_building_blocks c ON c.id = v.mindset_id""",
    "f_ondemand_skills": """
        SELECT s.sessionid, k.skill, k.score AS skill_score, s.score AS SessionScore,
               row_number() OVER (PARTITION BY s.sessionid ORDER BY k.skill, k.id) AS rn
        FROM f_skill_score k LEFT JOIN f_session_score s ON s.id = k.sessionscoreid""",
    "f_skill_domain_name": """
        SELECT DISTINCT l.skill_id, m.domain_id, l.skill_name, b.title AS domain_name
        FROM f_live_skills l LEFT JOIN f_skill_domain_mapping m ON m.skill_id = l.skill_id
        LEFT JOIN d_building_blocks b ON b.id = m.domain_id""",
    "live_sessions": f"""
        SELECT s.id, s.scenario_id, {SESSION.replace("status,", "s.status,", 1)}, r.user_id AS learner_id,
               (SELECT max(k.score) FROM f_live_skills k WHERE k.sessionid = s.id) AS score
        FROM f_live_session s LEFT JOIN m_session_learner p ON p.session_id = s.id
        LEFT JOIN (SELECT * FROM m_client_user_role WHERE role = 'learner') r ON r.id = p.user_role_id""",
    "ondemand_sessions": """
        SELECT o.id, o.scenario_id,
               CASE WHEN o.completed = 1 THEN 'COMPLETED' WHEN o.started_at IS NULL THEN 'PENDING'
                    ELSE 'IN_PROGRESS' END AS status,
               o.started_at AS actual_start_date, o.ended_at AS actual_end_date,
               o.started_at AS start_date, o.ended_at AS end_date, NULL::BOOLEAN AS billable,
               NULL::VARCHAR AS sub_type, NULL::BOOLEAN AS late_canceled,
               NULL::VARCHAR AS final_session_sub_status, o.created_at AS session_date, o.learner_id, p.score
        FROM f_ondemand_session o LEFT JOIN f_session_score p ON p.sessionid = o.id""",
    "f_sessions_final": f"""
        SELECT m.id, m.scenario_id, {SESSION}, m.learner_id, m.session_type, s.name AS scenario_name,
               s.name_customized AS scenario_custom_name, s.project_id AS scenario_project_id,
               s.client_id AS scenario_client_id, j.name AS project_name, c.name AS client_name
        FROM (SELECT *, 'live' AS session_type FROM live_sessions
              UNION ALL BY NAME SELECT *, 'ondemand' AS session_type FROM ondemand_sessions) m
        LEFT JOIN d_scenario s ON s.id = m.scenario_id
        LEFT JOIN d_project j ON j.id = s.project_id
        LEFT JOIN d_client c ON c.id = s.client_id""",
    "user_roles": """
        SELECT u.id AS user_id, u.activation_date AS user_activation_date, u.first_name, u.last_name,
               u.email, c.id AS user_client_id, c.name AS user_client_name, c.archived AS user_client_archived,
               c.operated_by AS user_client_operated_by, r.id AS client_user_role_id, r.role AS user_role
        FROM d_users u LEFT JOIN m_user_client m ON m.id = u.id LEFT JOIN d_client c ON c.id = m.client_id
        LEFT JOIN m_client_user_role r ON r.user_id = u.id""",
    "current_assignments": """
        SELECT DISTINCT u.user_id, t.team_id, s.scenario_id
        FROM user_roles u LEFT JOIN m_team_member t ON t.user_role_id = u.client_user_role_id
        LEFT JOIN m_scenario_team s ON s.team_id = t.team_id""",
    "shared_teams": """
        SELECT s.scenario_id, r.user_id, min(s.team_id) AS team_id
        FROM raw_scenario_team s JOIN raw_team_member t ON t.team_id = s.team_id
        JOIN m_client_user_role r ON r.id = t.user_role_id GROUP BY s.scenario_id, r.user_id""",
    "all_assignments": """
        SELECT user_id, team_id, scenario_id FROM current_assignments
        UNION
        SELECT f.learner_id, t.team_id, f.scenario_id
        FROM f_sessions_final f
        LEFT JOIN shared_teams t ON t.user_id = f.learner_id AND t.scenario_id = f.scenario_id
        WHERE f.learner_id IS NOT NULL AND f.scenario_id IS NOT NULL AND NOT EXISTS (
            FROM current_assignments c WHERE c.user_id = f.learner_id AND c.scenario_id = f.scenario_id)""",
    "team_sessions": f"""
        SELECT coalesce(sc.id, u.user_client_id) AS client_id, a.user_id, u.user_activation_date,
               u.first_name, u.last_name, u.email, u.first_name || ' ' || u.last_name AS full_name,
               coalesce(sc.name, u.user_client_name) AS client_name,
               coalesce(sc.archived, u.user_client_archived) AS client_archived,
               coalesce(sc.operated_by, u.user_client_operated_by) AS client_operated_by,
               u.user_role, u.client_user_role_id, a.team_id, t.name AS team_name, a.scenario_id,
               s.name AS scenario_name, s.name_customized AS customized_scenario_name, s.project_id,
               j.name AS project_name, f.id AS session_id, {SESSION}, f.session_type,
               s.generation_type AS scenario_generation_type
        FROM all_assignments a
        LEFT JOIN user_roles u ON u.user_id = a.user_id
        LEFT JOIN d_team t ON t.id = a.team_id
        LEFT JOIN d_scenario s ON s.id = a.scenario_id
        LEFT JOIN d_client sc ON sc.id = s.client_id
        LEFT JOIN d_project j ON j.id = s.project_id
        LEFT JOIN f_sessions_final f ON f.learner_id = a.user_id AND f.scenario_id = a.scenario_id""",
    "f_team_sessions_final": """
        SELECT * FROM team_sessions
        UNION ALL
        SELECT b.* REPLACE (n.id AS client_id)
        FROM team_sessions b, (VALUES ('C5-COPY-A'), ('C5-COPY-B')) AS n(id) WHERE b.client_id = 'C5'""",
    "scored_rows": """
        SELECT f.*, coalesce(o.skill, l.skill_name) AS skill,
               coalesce(o.skill_score, l.skill_score)::DOUBLE AS skill_score,
               coalesce(o.SessionScore, l.score)::DOUBLE AS SessionScore, l.event_number, e.events_sequence,
               l.skill_id, e.skill_id AS event_skill_id, b.id AS scenario_bank_id, b.min_passing_score,
               l.skill_name AS domain, k.title, l.mindset_type,
               CASE WHEN l.mindset_type = 'Positive' THEN 1 ELSE 0 END AS levent_status, l.old_skill_name,
               o.skill AS ondemand_skill
        FROM f_team_sessions_final f
        LEFT JOIN f_ondemand_skills o ON o.sessionid = f.session_id AND f.session_type = 'ondemand'
        LEFT JOIN f_live_skills l ON l.sessionid = f.session_id AND f.session_type = 'live'
        LEFT JOIN d_events e ON e.scenario_id = f.scenario_id AND e.events_sequence = l.event_number
        LEFT JOIN d_building_blocks k ON k.id = e.skill_id
        LEFT JOIN d_scenario_bank_event_scoring b ON b.scenario_id = f.scenario_id
        WHERE f.user_role = 'learner' AND f.scenario_generation_type = 1""",
    "f_score": f"""
        SELECT * EXCLUDE (ondemand_skill, scenario_generation_type, first_name, last_name, email,
                          full_name),
               row_number() OVER (PARTITION BY client_user_role_id, coalesce(ondemand_skill, title)
                                  ORDER BY {TIES}, attempt) AS CompetencyAttempt
        FROM (SELECT *, row_number() OVER (PARTITION BY client_id, user_id, scenario_id, skill, session_type
                                        ORDER BY {TIES}) AS attempt
              FROM scored_rows)""",
}
