"""Raw feeds made from general business tables, for trials and benchmarks.

Every feed is derived row by row from the whole of one table (customers become users, parts become
scenarios, orders live sessions, events on-demand sessions, conversations surveys), so it grows with
it. Keys are spread by arithmetic that any SQL engine can repeat. Second versions, deletes, archived
rows, blanks and NULLs are mixed in so that every rule of the models has rows to act on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Callable[[str], DataFrame]

FAN_OUT_CLIENT = "C5"
FAN_OUT_COPIES = ("C5-COPY-A", "C5-COPY-B")
SPREAD_ROWS = 100_000


def tables_in(spark: SparkSession, folder: str) -> Tables:
    """The tables of a folder by name, each opened once."""

    @cache
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")

    return table


def _count(t: Tables, name: str) -> Column:
    """The size of a table as a scalar subquery."""
    return t(name).agg(F.count("*").alias("n")).scalar()


def _spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out by `key`, SPREAD_ROWS rows to a task about, before its rows are multiplied.

    A column of keys takes so little room in a file that one task may read all of it; what it makes of them is sorted there.
    """
    tasks = -(-df.count() // SPREAD_ROWS)
    return df.repartition(tasks, key) if tasks > 1 else df


def _each(df: DataFrame, name: str, values: str) -> DataFrame:
    """A row per value of an array expression."""
    return df.withColumn(name, F.explode(F.expr(values)))


def _versions(df: DataFrame, second: str) -> DataFrame:
    """Version 0 of every row, and version 1 where `second` holds."""
    return _each(df, "rev", f"if({second}, array(0, 1), array(0))")


def raw_client(t: Tables) -> DataFrame:
    return _versions(t("nation"), "n_nationkey % 2 = 0").selectExpr(
        "concat('C', n_nationkey) as id",
        "if(rev = 1, concat(n_name, ' v1'), n_name) as name",
        "rev = 1 and n_nationkey % 11 = 10 as archived",
        "concat('G', n_regionkey) as operated_by",
        "cast(rev as bigint) as modify_revision",
    )


def raw_users(t: Tables) -> DataFrame:
    return _versions(t("customer"), "c_custkey % 3 = 0").selectExpr(
        "concat('U', c_custkey) as id",
        "c_name as first_name",
        "if(c_custkey % 13 = 0, null, concat(c_mktsegment, rev)) as last_name",
        "concat('u', c_custkey, '@example.com') as email",
        "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 1000 as int))"
        " as activation_date",
        "rev = 1 and c_custkey % 51 = 0 as archived",
        "cast(rev as bigint) as modify_revision",
    )


def raw_client_user(t: Tables) -> DataFrame:
    return _versions(t("customer"), "c_custkey % 4 = 0").selectExpr(
        "if(rev = 0, 'I', 'U') as op",
        "concat('U', c_custkey) as id",
        "concat('C', (c_nationkey + rev) % 25) as client_id",
        "c_custkey % 29 = 0 as archived",
    )


def raw_client_user_role(t: Tables) -> DataFrame:
    roles = _each(
        t("customer"), "role",
        "if(c_custkey % 5 = 0, array('learner', 'facilitator'), array('learner'))",
    )
    return _versions(roles, "c_custkey % 7 = 0").selectExpr(
        "concat('R', c_custkey * 10 + if(role = 'learner', 0, 1)) as id",
        "concat('U', c_custkey) as user_id",
        "role",
        "cast(rev as bigint) as version",
    )


def raw_team(t: Tables) -> DataFrame:
    return _each(t("supplier"), "rev", "array(0, 1)").selectExpr(
        "concat('T', s_suppkey) as id",
        "concat(s_name, ' v', rev) as name",
        "cast(rev as bigint) as modify_revision",
    )


def raw_team_member(t: Tables) -> DataFrame:
    members = t("customer").withColumn("n_team", _count(t, "supplier"))
    rows = _each(
        members, "m",
        """concat(
            array(named_struct('step', 0, 'op', if(c_custkey % 23 = 0, null, 'I'))),
            if(c_custkey % 19 = 0, array(named_struct('step', 0, 'op', 'D')), array()),
            if(c_custkey % 6 = 0, array(named_struct('step', 1, 'op', 'I')), array()))""",
    )
    return rows.selectExpr(
        "m.op as op",
        "concat('T', (c_custkey + m.step) % n_team) as team_id",
        "concat('R', c_custkey * 10) as user_role_id",
    )


def raw_industry(t: Tables) -> DataFrame:
    return _each(t("region"), "rev", "array(0, 1)").selectExpr(
        "concat('I', r_regionkey) as id",
        "concat(r_name, ' v', rev) as name",
        "cast(rev as bigint) as modify_revision",
    )


def raw_project(t: Tables) -> DataFrame:
    return _each(t("part").select("p_brand").distinct(), "rev", "array(0, 1)").selectExpr(
        "p_brand as id",
        "concat('Project ', p_brand, ' v', rev) as name",
        "rev = 1 and p_brand = 'Brand#13' as archived",
        "cast(rev as bigint) as modify_revision",
    )


def raw_scenario(t: Tables) -> DataFrame:
    return _versions(t("part"), "p_partkey % 2 = 1 or p_partkey % 31 = 30").selectExpr(
        "concat('S', p_partkey) as id",
        "concat(p_name, ' ', rev) as name",
        "if(p_partkey % 2 = 0, null, concat(p_name, ' custom')) as name_customized",
        "p_brand as project_id",
        "concat('C', p_partkey % 25) as client_id",
        "1 + p_size % 2 as generation_type",
        "rev = 1 and p_partkey % 31 = 30 as archived",
        "cast(rev as bigint) as modify_revision",
    )


def raw_scenario_team(t: Tables) -> DataFrame:
    scenarios = t("part").withColumn("n_team", _count(t, "supplier"))
    rows = _each(
        scenarios, "m",
        """concat(
            array(named_struct('step', 0, 'op', if(p_partkey % 37 = 5, 'D', 'I'))),
            if(p_partkey % 10 = 0, array(named_struct('step', 0, 'op', 'U')), array()),
            if(p_partkey % 4 = 0, array(named_struct('step', 3, 'op', 'I')), array()))""",
    )
    return rows.selectExpr(
        "m.op as op",
        "concat('S', p_partkey) as scenario_id",
        "concat('T', (p_partkey + m.step) % n_team) as team_id",
    )


def raw_scenario_building_block(t: Tables) -> DataFrame:
    return _each(t("part"), "rev", "array(0, 1)").selectExpr(
        "concat('SB', p_partkey) as id",
        "concat('S', p_partkey) as scenario_id",
        "concat('B', (p_partkey + rev) % 20) as building_block_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(rev) as operated_on",
    )


def raw_scenario_goals(t: Tables) -> DataFrame:
    goals = _each(_spread(t("part").select("p_partkey"), "p_partkey"), "goal_index", "array(1, 2, 3)")
    rows = _each(
        goals, "op",
        """concat(
            array(element_at(array('I', 'U', 'D', null), cast((p_partkey + goal_index) % 4 as int) + 1)),
            if((p_partkey + goal_index) % 5 = 0, array('D'), array()))""",
    )
    return rows.selectExpr("op", "concat('S', p_partkey) as scenario_id", "goal_index")


def raw_scenario_bank_event_scoring(t: Tables) -> DataFrame:
    banks = _each(t("part"), "bank", "if(p_partkey % 17 = 0, array('', 'x'), array(''))")
    return _versions(banks, "p_partkey % 9 = 0").selectExpr(
        "concat('SB', p_partkey, bank) as id",
        "concat('S', p_partkey) as scenario_id",
        "concat(' <p> ', p_name, '</p>&nbsp;') as synopsis",
        "p_size as min_passing_score",
        "5 as event_count",
        "p_retailprice as passing_score_percentage",
        "concat('a<br>', p_type, '&hellip;&amp;') as opportunity_development",
        "if(p_partkey % 3 = 0, null, concat('\\t', p_type, '\\n')) as successful_assessment",
        "concat('O', p_partkey) as origin_id",
        "cast(rev as bigint) as version",
    )


def raw_building_blocks(t: Tables) -> DataFrame:
    return _versions(t("part"), "p_partkey % 3 = 0").selectExpr(
        "concat('B', p_partkey) as id",
        """concat('<p>', case p_partkey % 5 when 0 then 'Strong' when 1 then 'Competent'
            when 2 then 'Emerging' when 3 then 'Novice' else p_type end, '</p>') as title""",
        "concat('<div>', p_name, '&rsquo;s</div> v', rev) as description",
        "case p_partkey % 3 when 0 then 'skill' when 1 then 'domain' else 'mindset' end"
        " as building_block_type",
        "case when p_size % 10 = 0 then 'Neutral' when p_size % 2 = 0 then 'Positive' else 'Derailing' end"
        " as type",
        "concat('level ', p_size % 4) as level",
        "concat('C', p_partkey % 25) as licensee_id",
        "p_partkey % 97 = 96 as archived",
        "cast(rev as bigint) as version",
    )


def raw_events(t: Tables) -> DataFrame:
    events = _each(
        _spread(t("part").select("p_partkey"), "p_partkey").withColumn("n_part", _count(t, "part")), "n", "array(1, 2, 3, 4, 5)"
    )
    return _versions(events, "p_partkey % 8 = 0").selectExpr(
        "concat('E', p_partkey * 5 + n) as id",
        "concat('S', p_partkey) as scenario_id",
        "concat('B', (p_partkey + n + rev) % n_part) as skill_id",
        "n as events_sequence",
        "p_partkey % 61 = 60 as archived",
        "cast(rev as bigint) as version",
    )


def raw_events_assessment(t: Tables) -> DataFrame:
    return _versions(t("part"), "p_partkey % 2 = 0").selectExpr(
        "concat('EA', p_partkey) as id",
        "rev = 1 and p_partkey % 7 = 0 as archived",
        "cast(rev as bigint) as version",
    )


def raw_events_mindset(t: Tables) -> DataFrame:
    parts = _spread(t("part").select("p_partkey"), "p_partkey").withColumn("n_part", _count(t, "part"))
    mindsets = _each(parts, "n", "array(0, 1)")
    return _versions(mindsets, "p_partkey % 5 = 0").selectExpr(
        "concat('M', p_partkey * 2 + n) as id",
        "concat('B', (p_partkey + rev) % n_part) as mindset_id",
        "cast(rev as bigint) as version",
    )


def raw_skill_domain_mapping(t: Tables) -> DataFrame:
    rows = _each(
        t("part"), "m",
        """concat(
            array(named_struct('step', 0, 'op', 'I')),
            if(p_partkey % 4 = 0, array(named_struct('step', 1, 'op', 'U')), array()),
            if(p_partkey % 15 = 0, array(named_struct('step', 2, 'op', 'D')), array()))""",
    )
    return rows.selectExpr(
        "m.op as op",
        "concat('K', p_partkey) as skill_id",
        "concat('B', (p_partkey + m.step) % 20) as domain_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(m.step) as operated_on",
        "p_partkey % 33 = 0 as archived",
    )


def raw_session(t: Tables) -> DataFrame:
    sessions = t("orders").withColumn("n_part", _count(t, "part"))
    return _versions(sessions, "o_orderkey % 3 = 0").selectExpr(
        "concat('L', o_orderkey) as id",
        "concat('S', (o_custkey + o_orderkey % 3) % n_part) as scenario_id",
        """case when rev = 0 and o_orderkey % 3 = 0 then 'DRAFT' when o_orderstatus = 'F' then 'COMPLETED'
            when o_orderstatus = 'P' then 'IN_PROGRESS' else 'PENDING' end as status""",
        "o_orderpriority as sub_type",
        "concat(o_orderstatus, '-', o_orderpriority) as final_session_sub_status",
        "if(o_orderstatus = 'F', o_orderdate + make_dt_interval(0, 0, 5), null) as actual_start_date",
        "if(o_orderstatus = 'F', o_orderdate + make_dt_interval(0, 0, 55), null) as actual_end_date",
        "if(o_orderkey % 41 = 0, null, o_orderdate) as start_date",
        "if(o_orderkey % 41 = 0, null, o_orderdate + make_dt_interval(0, 1)) as end_date",
        "o_totalprice > 100000 as billable",
        "o_orderkey % 17 = 0 as late_canceled",
        "cast(rev as bigint) as modify_revision",
    )


def raw_session_learner(t: Tables) -> DataFrame:
    rows = _each(
        t("orders"), "m",
        """concat(
            array(named_struct('step', 0, 'op', 'I')),
            if(o_orderkey % 10 = 0, array(named_struct('step', 0, 'op', 'I')), array()),
            if(o_orderkey % 43 = 0, array(named_struct('step', 0, 'op', 'D')), array()),
            if(o_custkey % 5 = 0, array(named_struct('step', 1, 'op', 'I')), array()))""",
    )
    return rows.selectExpr(
        "m.op as op",
        "concat('L', o_orderkey) as session_id",
        "concat('R', o_custkey * 10 + m.step) as user_role_id",
        "cast(1 + o_orderkey % 5 as int) as score",
    )


def raw_sim_feedback(t: Tables) -> DataFrame:
    surveys = t("orders").withColumn("n_part", _count(t, "part"))
    surveys = _versions(surveys, "o_orderkey % 6 = 0")
    slots = []
    for n in range(1, 6):
        slots += [
            f"""case (o_orderkey + {n}) % 12 when 0 then '' when 4 then '  ' when 8 then null
                else concat('K', (o_orderkey * 7 + {n}) % n_part) end
                as `SIM_FEEDBACK.event{n}skillid`""",
            f"""concat('<p class="s"> Skill ', (o_orderkey * 7 + {n}) % n_part, ' </p>')
                as `SIM_FEEDBACK.event{n}skillname`""",
            f"""if((o_orderkey + {n}) % 9 = 0, null, concat('M', (o_orderkey + {n}) % (2 * n_part)))
                as `SIM_FEEDBACK.selectedevent{n}mindsetid`""",
        ]
    return surveys.selectExpr(
        "if(rev = 0, 'I', 'U') as op",
        """case when o_orderkey % 47 = 0 then '  ' when o_orderkey % 10 = 0 then concat('L', o_orderkey, ' ')
            else concat('L', o_orderkey) end as `SIM_FEEDBACK.sessionId`""",
        "concat('web', o_orderkey % 3) as `SIM_FEEDBACK.webportal`",
        "'true' as `SIM_FEEDBACK.finished`",
        "concat(if(rev = 0, date_format(o_orderdate, 'yyyy-MM-dd'), '2030-01-31'),"
        " if(o_orderkey % 8 = 0, ' ', '')) as `SIM_FEEDBACK.recordedDate`",
        "concat('gen', o_orderkey % 2) as `SIM_FEEDBACK.generationType`",
        "if(o_orderkey % 53 = 0, null, cast(1 + (o_orderkey + rev) % 5 as int)) as `SIM_FEEDBACK.score`",
        "concat('A', o_orderkey % 100) as `SIM_FEEDBACK.strengthassessmentid`",
        "concat('A', o_orderkey % 101) as `SIM_FEEDBACK.opportunitiesassessmentid`",
        *slots,
    )


def raw_ondemand_session(t: Tables) -> DataFrame:
    sessions = t("events").withColumn("n_part", _count(t, "part"))
    return _versions(sessions, "event_id % 5 = 0").selectExpr(
        "concat('O', event_id) as id",
        "concat('S', (user_id + event_id % 4) % n_part) as scenario_id",
        "concat('U', user_id) as learner_id",
        "if(event_type = 'purchase', 1, 0) as completed",
        "if(event_type = 'click', null, ts) as started_at",
        "if(event_type = 'purchase' and rev = 0, ts + make_dt_interval(0, 0, 10), null) as ended_at",
        "ts - make_dt_interval(rev) as created_at",
    )


def raw_ondemand_session_event(t: Tables) -> DataFrame:
    return t("events").selectExpr(
        "concat('OE', event_id) as id", "concat('O', event_id) as session_id", "event_type", "ts"
    )


def raw_session_score(t: Tables) -> DataFrame:
    rows = _each(
        t("events"), "step",
        """concat(array(0), if(event_id % 2 = 0, array(1), array()),
            if(event_id % 7 = 0, array(2), array()))""",
    )
    return rows.selectExpr(
        "concat('SS', event_id) as id",
        "if(step = 2, null, ts + make_dt_interval(step)) as createdat",
        "ts + make_dt_interval(step) as updatedat",
        "cast(null as timestamp_ntz) as deletedat",
        "if(event_type = 'error', null, concat('O', event_id - if(event_id % 10 = 1, 1, 0))) as sessionid",
        "value + step as score",
        "concat('goal ', event_type) as goaldescription",
        "concat('U', user_id) as userid",
        "concat('C', user_id % 25) as clientid",
    )


def raw_skill_score(t: Tables) -> DataFrame:
    skills = _each(t("events"), "i", "array(0, 1, 2)")
    rows = _each(skills, "step", "if(i = 0, array(0, 1), array(0))")
    return rows.selectExpr(
        "concat('KS', event_id * 3 + i) as id",
        "ts + make_dt_interval(step) as createdat",
        "ts as updatedat",
        "cast(null as timestamp_ntz) as deletedat",
        "concat('K', i) as skillid",
        "element_at(array('Listening', 'Empathy', 'Clarity'), i + 1) as skill",
        "concat('about ', i) as skilldescription",
        "concat('capability ', i % 2) as capability",
        "'described' as capabilitydescription",
        "event_type as pillar",
        "cast(get_json_object(props, '$.k') as double) + i + step as score",
        "if(event_id % 11 = 0, null, concat('SS', event_id)) as sessionscoreid",
    )


def raw_session_insights_service(t: Tables) -> DataFrame:
    return _versions(t("events"), "event_id % 3 = 0").selectExpr(
        "if(rev = 0, 'I', 'U') as op", "concat('IN', event_id) as id", "value + rev as insight"
    )


def raw_post_simulation(t: Tables) -> DataFrame:
    """A survey per message of a conversation, its answers made from the whole message."""
    rows = _versions(t("conversations"), "conv_id % 2 = 0")
    answers = rows.withColumn(
        "question",
        F.expr("element_at(array('Q1', 'Q2', 'Q3_1', 'Q3_2', 'Q13', 'Q99', 'Q62', 'Q26'),"
               " cast(turn % 8 as int) + 1)"),
    ).withColumn(
        "answers",
        F.expr(
            """to_json(concat(
                array(named_struct('questionId', question,
                    'questionText', concat('<p>', text, '</p>&nbsp;'),
                    'answerText', concat(' ', role, '\\n'), 'selectedAnswerNumber', turn + rev)),
                if(conv_id % 10 = 9, array(), array(named_struct('questionId', 'Q14',
                    'questionText', role, 'answerText', concat('<b>', text, '</b>'),
                    'selectedAnswerNumber', turn + 1))),
                if(conv_id % 3 = 0, array(named_struct('questionId', question,
                    'questionText', role, 'answerText', concat('z', role),
                    'selectedAnswerNumber', turn + 2)), array()),
                array(named_struct('questionId', 'Q99', 'questionText', 'other', 'answerText', 'other',
                    'selectedAnswerNumber', 0L))))"""
        ),
    )
    return answers.selectExpr(
        "concat(if(conv_id % 7 = 0, '\\t', ''), 'L', conv_id, '-', turn) as `POST_SIMULATION.sessionId`",
        "concat(' U', conv_id, ' ') as `POST_SIMULATION.userid`",
        "concat('web', turn % 3) as `POST_SIMULATION.webportal`",
        "'true' as `POST_SIMULATION.finished`",
        "if(rev = 0, concat('2024-1-', 1 + turn), '2023-12-31 ') as `POST_SIMULATION.recordedDate`",
        "if(conv_id % 31 = 0, null, answers) as `array_POST_SIMULATION.questions`",
    )


def raw_session_learner_report(t: Tables) -> DataFrame:
    groups = {
        "simfeedback": "sf", "presimulationconfidence": "pre", "postsimulationconfidence": "post",
    }
    fields = []
    for group, short in groups.items():
        for field in ("questionid", "questiontext", "answertext"):
            fields.append(
                f"concat('{short} {field} ', o_orderpriority, rev)"
                f" as `session_learner_report.{group}.{field}`"
            )
        fields.append(
            f"cast((o_orderkey + rev) % 5 as string)"
            f" as `session_learner_report.{group}.selectedanswernumber`"
        )
    return _versions(t("orders"), "o_orderkey % 3 = 0").selectExpr(
        "if(rev = 0, 'I', 'U') as op",
        "concat('LR', o_orderkey, '-', rev) as _id",
        "concat('L', o_orderkey) as `session_learner_report.sessionid`",
        "concat('[', o_orderstatus, ']') as `array_session_learner_report.strategies`",
        "o_orderpriority as `session_learner_report.presimulationconfidence`",
        *fields,
        "concat('oid', o_orderkey) as oid__id",
    )


SHAPES: dict[str, Callable[[Tables], DataFrame]] = {
    f.__name__: f
    for f in [
        raw_client, raw_users, raw_client_user, raw_client_user_role, raw_team, raw_team_member,
        raw_industry, raw_project, raw_scenario, raw_scenario_team, raw_scenario_building_block,
        raw_scenario_goals, raw_scenario_bank_event_scoring, raw_building_blocks, raw_events,
        raw_events_assessment, raw_events_mindset, raw_skill_domain_mapping, raw_session,
        raw_session_learner, raw_sim_feedback, raw_ondemand_session, raw_ondemand_session_event,
        raw_session_score, raw_skill_score, raw_session_insights_service, raw_post_simulation,
        raw_session_learner_report,
    ]
}
