"""SQL for the registered queries, composed from the feeds and models it names."""

import re

from .models import MODELS, clean, paragraphs
from .shaped import SHAPED

PARTS = {**SHAPED, **MODELS}


def _used(sql: str) -> set[str]:
    return set(re.findall(r"\w+", sql)) & PARTS.keys()


def compose(sql: str) -> str:
    """Put the statements that `sql` names in front of it, in an order that works."""
    needed: set[str] = set()
    todo = _used(sql)
    while todo:
        name = todo.pop()
        needed.add(name)
        todo |= _used(PARTS[name]) - {name} - needed
    if not needed:
        return sql
    parts = [f"{name} AS MATERIALIZED ({text})" for name, text in PARTS.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def _tokens(text: str) -> str:
    return f"regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+')"


# Tables with one key column, or with several that are a key together.
DECLARED = dict.fromkeys(
    """d_building_blocks d_client d_events d_industry d_project d_scenario d_scenario_bank_event_scoring d_team
    d_users f_events_assessment f_events_mindset f_live_session f_ondemand_session f_ondemand_session_event
    f_session_insights_service f_session_score f_skill_score m_client_user_role m_scenario_building_block
    m_user_client""".split(), ("id",)
) | {
    "d_learner_confidence": ("session_id",), "d_post_simulation": ("sessionid",),
    "f_skill_domain_mapping": ("skill_id",), "m_skill_score_mindset": ("events_mindset_id",),
    "d_scenario_goals": ("scenario_id", "goal_index"), "f_live_skills": ("sessionid", "skill_id", "event_number"),
    "f_ondemand_skills": ("sessionid", "skill", "rn"), "m_scenario_team": ("scenario_id", "team_id"),
    "m_session_learner": ("session_id", "user_role_id"), "m_team_member": ("team_id", "user_role_id"),
}


def _declared(table: str, keys: tuple[str, ...]) -> str:
    kind = "unique" if len(keys) == 1 else "unique_combination"
    known = f"AND {keys[0]} IS NOT NULL" if len(keys) == 1 else ""
    parts = [f"""SELECT '{table}' AS "table", '{kind}' AS "check", '{", ".join(keys)}' AS "columns",
            count(*) FILTER (WHERE n > 1 {known}) AS failing_rows
            FROM (SELECT {", ".join(keys)}, count(*) AS n FROM {table} GROUP BY ALL)"""]
    parts += [f"SELECT '{table}', 'not_null', '{k}', count(*) - count({k}) FROM {table}" for k in keys]
    return " UNION ALL ".join(parts)


OPERATORS = {
    "latest_by_revision": """
        SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice,
               l_discount, l_tax
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey,
            l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) = 1""",
    "latest_session": "SELECT id, modify_revision, status, session_date FROM f_live_session",
    "latest_archived_hidden": """
        SELECT DISTINCT id FROM raw_users r
        WHERE NOT archived AND NOT EXISTS (FROM d_users d WHERE d.id = r.id)""",
    "tombstone_null_kept": "SELECT scenario_id, goal_index, op FROM d_scenario_goals",
    "tombstone_null_dropped": "SELECT team_id, user_role_id, op FROM m_team_member",
    "tombstone_ignored": "SELECT scenario_id, team_id, op FROM m_scenario_team",
    "any_delete_pairs": "SELECT * FROM m_session_learner",
    "earliest_created_score": "SELECT id, createdat, updatedat, score FROM f_session_score",
    "html_clean_pages": f"""
        SELECT page_id, {clean("html || '&nbsp;&rsquo;'")} AS cleaned FROM pages""",
    "strip_p_pages": f"SELECT page_id, {paragraphs('html')} AS stripped FROM pages",
    "slot_unpivot": """
        SELECT * REPLACE (event_number::INTEGER AS event_number) FROM survey_events""",
    "explode_answers": """
        SELECT sessionid, recordeddate, qid AS questionId, question AS questionText, answer AS answerText,
               num AS selectedAnswerNumber
        FROM exploded_answers""",
    "json_pivot_answers": "SELECT * FROM d_post_simulation",
    "flatten_report": "SELECT * EXCLUDE (row_number) FROM d_learner_confidence",
    "proficiency_ladder": """
        SELECT sessionid, event_number, CompetencyID, mindset_score, mindset_type, skill_score, score
        FROM f_live_skills""",
    "session_status": "SELECT id, completed, started_at, status FROM f_ondemand_session JOIN "
                      "(SELECT DISTINCT id, status FROM ondemand_sessions) USING (id)",
    "best_score_lookup": "SELECT id, learner_id, score FROM live_sessions",
    "tagged_union_sessions": """
        SELECT 'live' AS session_type, id, scenario_id, learner_id, start_date,
               session_date::TIMESTAMP AS session_date, billable FROM live_sessions
        UNION ALL
        SELECT 'ondemand', id, scenario_id, learner_id, start_date, session_date, NULL
        FROM ondemand_sessions""",
    "routing_join": """
        SELECT f.id, f.learner_id, f.session_type, o.skill, o.skill_score, l.event_number, l.skill_id
        FROM f_sessions_final f
        LEFT JOIN f_ondemand_skills o ON o.sessionid = f.id AND f.session_type = 'ondemand'
        LEFT JOIN f_live_skills l ON l.sessionid = f.id AND f.session_type = 'live'""",
    "user_client_roles": "SELECT * FROM user_roles",
    "current_assignments": "SELECT * FROM current_assignments",
    "anti_history": "SELECT * FROM all_assignments",
    "one_team_per_pair": """
        SELECT DISTINCT t.user_id, t.scenario_id, t.team_id
        FROM shared_teams t JOIN f_sessions_final f
          ON f.learner_id = t.user_id AND f.scenario_id = t.scenario_id""",
    "fan_out_client": """
        SELECT id, name, 'C5-COPY-A' AS client_id FROM d_scenario WHERE client_id = 'C5'
        UNION ALL SELECT id, name, 'C5-COPY-B' FROM d_scenario WHERE client_id = 'C5'
        UNION ALL SELECT id, name, client_id FROM d_scenario""",
    "skill_rank": "SELECT * FROM f_ondemand_skills",
    "attempt_numbers": """
        SELECT id, learner_id, scenario_id, session_type, start_date,
               row_number() OVER (PARTITION BY scenario_client_id, learner_id, scenario_id, session_type
                                  ORDER BY start_date, id) AS attempt
        FROM f_sessions_final""",
    "competency_attempts": """
        SELECT sessionid, event_number, skill_id,
               row_number() OVER (PARTITION BY strengthAssessmentId, coalesce(mindset_score, skill_name)
                                  ORDER BY recordeddate, sessionid, event_number) AS CompetencyAttempt
        FROM f_live_skills""",
    "sessions_final": "SELECT * FROM f_sessions_final",
    "team_sessions_final": "SELECT * FROM f_team_sessions_final",
    "score": "SELECT * FROM f_score",
    "mindset_types": "SELECT mindset_id, type FROM m_skill_score_mindset",
    "check_unique": """
        SELECT 'unique' AS "check", c AS "columns", n AS failing_rows FROM (
            SELECT 'l_orderkey' AS c, count(*) AS n
            FROM (SELECT l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)
            UNION ALL SELECT 'l_shipdate', count(*)
            FROM (SELECT l_shipdate FROM lineitem GROUP BY ALL HAVING count(*) > 1))""",
    "check_not_null": """
        SELECT 'not_null' AS "check", c AS "columns", n::BIGINT AS failing_rows FROM (
            SELECT 'start_date' AS c, count(*) - count(start_date) AS n FROM raw_session
            UNION ALL SELECT 'actual_end_date', count(*) - count(actual_end_date) FROM raw_session
            UNION ALL SELECT 'id', count(*) - count(id) FROM raw_session)""",
    "check_accepted": """
        SELECT 'accepted_values' AS "check", c AS "columns", n AS failing_rows FROM (
            SELECT 'event_type' AS c, count(DISTINCT event_type) AS n FROM events
            WHERE event_type NOT IN ('click', 'view')
            UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events WHERE user_id NOT IN (0, 1))""",
    "check_unique_combo": """
        SELECT 'unique_combination' AS "check", 'l_orderkey, l_linenumber' AS "columns",
               count(*) AS failing_rows
        FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "check_declared": " UNION ALL ".join(
        [_declared(t, keys) for t, keys in DECLARED.items()]
        + ["""SELECT 'f_skill_domain_name', 'unique', 'id', NULL
        UNION ALL SELECT 'f_skill_domain_name', 'not_null', 'id', NULL
        UNION ALL SELECT 'm_session_learner', 'accepted_values', 'has_d_value',
            count(DISTINCT has_d_value) FROM m_session_learner WHERE has_d_value <> '0'
        UNION ALL SELECT 'm_session_learner', 'not_null', 'has_d_value', count(*) - count(has_d_value)
            FROM m_session_learner"""]
    ),
    "preview_text": """
        SELECT id, scenario_id, coalesce(status, '') AS status, coalesce(start_date::VARCHAR, '') AS start_date,
               coalesce(billable::VARCHAR, '') AS billable
        FROM f_live_session ORDER BY id LIMIT 100""",
    "lexical_topk": f"""
        WITH asked AS (
            SELECT query_id, token, count(*) AS weight
            FROM (SELECT item_id AS query_id, unnest({_tokens('"text"')}) AS token FROM benchmark)
            WHERE length(token) > 2 GROUP BY ALL),
        body AS (
            SELECT doc_id, token, count(*) AS hits
            FROM (SELECT doc_id, unnest({_tokens('"text"')}) AS token FROM documents)
            WHERE length(token) > 2 GROUP BY ALL),
        place AS (
            SELECT DISTINCT doc_id, token
            FROM (SELECT doc_id, unnest({_tokens('"source"')}) AS token FROM documents)
            WHERE length(token) > 2),
        scored AS (
            SELECT q.item_id AS query_id, d.doc_id, (d.lang = 'es')::BIGINT
                   + coalesce((SELECT sum(weight * least(hits, 5)) FROM asked a JOIN body b USING (token)
                               WHERE a.query_id = q.item_id AND b.doc_id = d.doc_id), 0)
                   + coalesce((SELECT sum(weight * 3) FROM asked a JOIN place p USING (token)
                               WHERE a.query_id = q.item_id AND p.doc_id = d.doc_id), 0) AS score
            FROM benchmark q, documents d)
        SELECT query_id, doc_id, score::BIGINT AS score,
               (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank
        FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "mention_tags": f"""
        SELECT doc_id, (i - 1)::INTEGER AS position, token
        FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i
              FROM (SELECT doc_id, {_tokens('"text"')} AS w FROM documents))
        WHERE token IN (SELECT unnest({_tokens('"text"')}) FROM benchmark) AND length(token) > 2""",
}

for name in ("routing_join", "attempt_numbers"):  # the same rows, another way
    OPERATORS[name + ("_split" if name == "routing_join" else "_ranged")] = OPERATORS[name]

OPERATORS["written_sessions"] = OPERATORS["latest_session"]

WAREHOUSE = {
    name: f"SELECT * FROM {name}"
    for name in MODELS
    if name[:2] in ("d_", "m_", "f_")
    and name not in ("f_sessions_final", "f_team_sessions_final", "f_score")
}
SQL = {name: compose(sql) for name, sql in {**WAREHOUSE, **OPERATORS}.items()}
