"""The queries that can be run against the general business tables, and SQL to compare them with."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextvars import copy_context
from functools import cache
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle.queries import SQL
from rosterlens.functions.scoring import session_status
from rosterlens.functions.text import html_clean, strip_p, words
from rosterlens.operators import search
from rosterlens.operators.cdc import latest_row
from rosterlens.operators.checks import AcceptedValues, NotNull, Unique, UniqueCombination, check_table
from rosterlens.operators.heavy import KeySketches
from rosterlens.operators.joins import routed_left_join, smallest_shared
from rosterlens.operators.numbering import number_rows
from rosterlens.operators.sets import fan_out_key, tagged_union
from rosterlens.plans import marts, warehouse
from rosterlens.plans.build import CHECKS, LOOKUP_KEYS, MODELS, check_all, inputs, make, watched
from rosterlens.sources import sinks
from rosterlens.sources.shaping import FAN_OUT_CLIENT, FAN_OUT_COPIES, SHAPES, tables_in
from rosterlens.sources.staging import stage, staging_dir

Query = Callable[[SparkSession, str], DataFrame]
OPTIONS = {
    "f_team_sessions_final": {"fan_out_client": FAN_OUT_CLIENT, "fan_out_copies": FAN_OUT_COPIES}
}
WRITERS = 4  # tables written side by side


def shared_tables(wanted: Mapping[str, int]) -> set[str]:
    """Models that are read more than once when `wanted` are made, and those that large lookups go to.

    They are written once, as the build job does; the others stay plans, of which only what is used is computed.
    """
    reads = Counter(wanted)
    for name in reversed(MODELS):  # users before what they use
        if reads[name]:
            reads.update(t for t in inputs(name) if t in MODELS)
    often = {"m_client_user_role", "f_sessions_final", "d_building_blocks"}  # read in several roles by one model
    return {
        name for name, n in reads.items()
        if n > 1 or (n and name not in wanted and (name in LOOKUP_KEYS or name in often))
    } & MODELS.keys()


class Trial:
    """Shaped feeds and models over the tables of one folder, each made when first asked for."""

    def __init__(self, spark: SparkSession, folder: str, used: Mapping[str, Sequence[str]] | None = None, **wanted: int):
        """`wanted`: the models a query asks for, and how many times it reads them. `used`: the columns shared models are written with, where not all."""
        self.spark = spark
        self.used = used or {}
        self.base = tables_in(spark, folder)
        self.keys = KeySketches()
        self.made: dict[str, DataFrame | Future] = {}
        shared = shared_tables(wanted)
        if shared:
            with ThreadPoolExecutor(WRITERS) as pool:
                for name in MODELS:  # those a table needs are asked for before it
                    if name in shared:
                        self.made[name] = pool.submit(copy_context().run, self.written, name)
            self.made = {name: df.result() if isinstance(df, Future) else df for name, df in self.made.items()}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = SHAPES[name](self.base) if name in SHAPES else self.model(name)
        found = self.made[name]
        return found.result() if isinstance(found, Future) else found

    def model(self, name: str) -> DataFrame:
        return make(name, {t: self[t] for t in inputs(name)}, self.keys, OPTIONS.get(name))

    def written(self, name: str) -> DataFrame:
        model = self.model(name)
        return stage(watched(self.keys, name, model.select(*self.used[name]) if name in self.used else model))

    def call(self, part: Callable[..., DataFrame], *names: str, **more: object) -> DataFrame:
        return part(*[self[n] for n in names], **more)


def _live_sessions(t: Trial) -> DataFrame:
    return t.call(marts.live_sessions, "f_live_session", "m_session_learner", "m_client_user_role", keys=t.keys)


def _ondemand_sessions(t: Trial) -> DataFrame:
    return t.call(marts.ondemand_sessions, "f_ondemand_session", "f_session_score", keys=t.keys)


def _current_assignments(t: Trial) -> DataFrame:
    return t.call(
        marts.current_team_scenarios,
        "d_users", "m_client_user_role", "m_team_member", "m_scenario_team", keys=t.keys,
    ).select("user_id", "team_id", "scenario_id")


def latest_by_revision(t: Trial) -> DataFrame:
    columns = [
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
    ]
    return latest_row(
        t.base("lineitem").select(*columns), ["l_orderkey", "l_linenumber"], [("l_shipdate", "desc")],
        tiebreak=columns[3:], keep_rank=False,
    )


def latest_session(t: Trial) -> DataFrame:
    return t["f_live_session"].select("id", "modify_revision", "status", "session_date")


def latest_archived_hidden(t: Trial) -> DataFrame:
    """Users with a live version that the newest, archived one hides."""
    return (
        t["raw_users"].filter(~F.col("archived")).select("id").distinct()
        .join(t["d_users"], "id", "left_anti")
    )


def tombstone_null_kept(t: Trial) -> DataFrame:
    return t["d_scenario_goals"].select("scenario_id", "goal_index", "op")


def tombstone_null_dropped(t: Trial) -> DataFrame:
    return t["m_team_member"].select("team_id", "user_role_id", "op")


def tombstone_ignored(t: Trial) -> DataFrame:
    return t["m_scenario_team"].select("scenario_id", "team_id", "op")


def any_delete_pairs(t: Trial) -> DataFrame:
    return t["m_session_learner"]


def earliest_created_score(t: Trial) -> DataFrame:
    return t["f_session_score"].select("id", "createdat", "updatedat", "score")


def html_clean_pages(t: Trial) -> DataFrame:
    text = F.concat("html", F.lit("&nbsp;&rsquo;"))
    return t.base("pages").select("page_id", html_clean(text).alias("cleaned"))


def strip_p_pages(t: Trial) -> DataFrame:
    return t.base("pages").select("page_id", strip_p(F.col("html")).alias("stripped"))


def slot_unpivot(t: Trial) -> DataFrame:
    return warehouse.survey_events(t["raw_sim_feedback"])


def explode_answers(t: Trial) -> DataFrame:
    answers = warehouse.survey_answers(t["raw_post_simulation"])
    return answers.select("sessionid", "recordeddate", F.inline("answers"))


def json_pivot_answers(t: Trial) -> DataFrame:
    return t["d_post_simulation"]


def flatten_report(t: Trial) -> DataFrame:
    return t["d_learner_confidence"].drop("row_number")


def proficiency_ladder(t: Trial) -> DataFrame:
    return t.model("f_live_skills").select(
        "sessionid", "event_number", "CompetencyID", "mindset_score", "mindset_type", "skill_score", "score"
    )


def status_of_sessions(t: Trial) -> DataFrame:
    return t["f_ondemand_session"].select(
        "id", "completed", "started_at",
        session_status(F.col("completed"), F.col("started_at")).alias("status"),
    )


def best_score_lookup(t: Trial) -> DataFrame:
    return marts.with_best_score(_live_sessions(t), t.model("f_live_skills")).select(
        "id", "learner_id", "score"
    )


def tagged_union_sessions(t: Trial) -> DataFrame:
    return tagged_union(
        {"live": _live_sessions(t), "ondemand": _ondemand_sessions(t)}, "session_type"
    ).select(
        "session_type", "id", "scenario_id", "learner_id", "start_date", "session_date", "billable"
    )


def routing_join(t: Trial, **bound: int) -> DataFrame:
    ondemand = t["f_ondemand_skills"].select(F.col("sessionid").alias("id"), "skill", "skill_score")
    live = t["f_live_skills"].select(F.col("sessionid").alias("id"), "event_number", "skill_id")
    sessions = t["f_sessions_final"].select("id", "learner_id", "session_type")
    heavy = {
        "ondemand": t.keys.of("f_ondemand_skills", "sessionid"), "live": t.keys.of("f_live_skills", "sessionid"),
    }
    return routed_left_join(sessions, "id", "session_type", {"ondemand": ondemand, "live": live}, heavy=heavy, **bound)


def routing_join_split(t: Trial) -> DataFrame:
    """The same with a bound that many sessions are over."""
    return routing_join(t, split_rows=3)


def user_client_roles(t: Trial) -> DataFrame:
    return t.call(marts.user_roles, "d_users", "m_user_client", "d_client", "m_client_user_role", keys=t.keys)


def anti_history(t: Trial) -> DataFrame:
    return t.call(
        lambda *tables: marts.all_team_scenarios(stage(_current_assignments(t)), *tables),
        "f_sessions_final", "m_client_user_role", "raw_scenario_team", "raw_team_member",
    )


def one_team_per_pair(t: Trial) -> DataFrame:
    pairs = (
        t["f_sessions_final"].select(F.col("learner_id").alias("user_id"), "scenario_id")
        .dropna().distinct()
    )
    roles = t["m_client_user_role"].select(F.col("id").alias("user_role_id"), "user_id")
    # Read several times below, so the link lists are written once, with the columns that are used.
    user_teams = stage(t["raw_team_member"].join(roles, "user_role_id").select("user_id", "team_id").distinct())
    scenario_teams = stage(t["raw_scenario_team"].select("scenario_id", "team_id").distinct())
    return smallest_shared(pairs, user_teams, scenario_teams, "user_id", "scenario_id", "team_id")


def fan_out_client(t: Trial) -> DataFrame:
    return fan_out_key(
        t["d_scenario"].select("id", "name", "client_id"), "client_id", FAN_OUT_CLIENT, FAN_OUT_COPIES
    )


def attempt_numbers(t: Trial, **bound: int) -> DataFrame:
    keys = ["scenario_client_id", "learner_id", "scenario_id", "session_type"]
    order = ["start_date", "id"]
    rows = stage(t.keys.watch("attempts", t["f_sessions_final"].select(*keys, *order), [keys], nulls=True))
    return number_rows(rows, keys, order, "attempt", heavy=t.keys.of("attempts", *keys), **bound).select(
        "id", "learner_id", "scenario_id", "session_type", "start_date", "attempt"
    )


def attempt_numbers_ranged(t: Trial) -> DataFrame:
    """The same with a bound that the large groups, as those without a learner, are over."""
    return attempt_numbers(t, task_rows=300)


def competency_attempts(t: Trial) -> DataFrame:
    keys, order = ["strengthAssessmentId", "competency"], ["recordeddate", "sessionid", "event_number"]
    named = t["f_live_skills"].withColumn("competency", F.coalesce("mindset_score", "skill_name"))
    rows = stage(t.keys.watch("competencies", named.select(*keys, *order, "skill_id"), [keys], nulls=True))
    return number_rows(rows, keys, order, "CompetencyAttempt", heavy=t.keys.of("competencies", *keys)).select(
        "sessionid", "event_number", "skill_id", "CompetencyAttempt"
    )


def mindset_types(t: Trial) -> DataFrame:
    return t["m_skill_score_mindset"].select("mindset_id", "type")


def check_unique(t: Trial) -> DataFrame:
    return check_table(t.base("lineitem"), [Unique("l_orderkey"), Unique("l_shipdate")])


def check_not_null(t: Trial) -> DataFrame:
    return check_table(
        t["raw_session"], [NotNull("start_date"), NotNull("actual_end_date"), NotNull("id")]
    )


def check_accepted(t: Trial) -> DataFrame:
    return check_table(
        t.base("events"),
        [AcceptedValues("event_type", ("click", "view")), AcceptedValues("user_id", ("0", "1"))],
    )


def check_unique_combo(t: Trial) -> DataFrame:
    return check_table(t.base("lineitem"), [UniqueCombination(("l_orderkey", "l_linenumber"))])


def check_declared(t: Trial) -> DataFrame:
    return check_all({n: t[n] for n in CHECKS})


def written_sessions(t: Trial) -> DataFrame:
    """A table replaced twice and read back."""
    path = f"{staging_dir(t.spark)}/written-{uuid.uuid4().hex}"
    sessions = latest_session(t)
    sinks.write_table(sessions.limit(1), path)
    sinks.write_table(sessions, path, order=["id"])
    return t.spark.read.parquet(path)


def preview_text(t: Trial) -> DataFrame:
    return sinks.preview(
        t["f_live_session"].select("id", "scenario_id", "status", "start_date", "billable"), order=["id"]
    )


def lexical_topk(t: Trial) -> DataFrame:
    asked = t.base("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.lexical_topk(
        t.base("documents"), "doc_id", "text", "source", asked, k=10, boost=F.col("lang") == "es"
    )


def team_sessions_final(t: Trial) -> DataFrame:
    """Written by a query of this module, under whose settings rows meet their sessions as they are dealt, by scenario."""
    return _team_sessions_written(t, t.model("f_team_sessions_final"))


def score(t: Trial) -> DataFrame:
    t.made["f_team_sessions_final"] = _team_sessions_written(t, marts.learner_rows(t["f_team_sessions_final"]))
    return t.model("f_score")


def _team_sessions_written(t: Trial, rows: DataFrame) -> DataFrame:
    tables = ("f_sessions_final", marts.WRITTEN_PARTS["f_team_sessions_final"])
    return stage(rows, by_one_key=marts.dealt_by_scenario(t.keys, *tables))


def mention_tags(t: Trial) -> DataFrame:
    names = t.base("benchmark").select(F.explode(words(F.col("text"))).alias("name"))
    return search.mention_tags(t.base("documents"), "doc_id", "text", names, "name")


QUERIES: dict[str, Callable[[Trial], DataFrame]] = {
    f.__name__: f
    for f in [
        latest_by_revision, latest_session, latest_archived_hidden, tombstone_null_kept,
        tombstone_null_dropped, tombstone_ignored, any_delete_pairs, earliest_created_score,
        html_clean_pages, strip_p_pages, slot_unpivot, explode_answers, json_pivot_answers,
        flatten_report, proficiency_ladder, best_score_lookup, tagged_union_sessions, routing_join,
        routing_join_split, user_client_roles, anti_history, one_team_per_pair, fan_out_client,
        attempt_numbers, attempt_numbers_ranged,
        competency_attempts, mindset_types, check_unique, check_not_null, check_accepted,
        check_unique_combo, check_declared, written_sessions, preview_text, lexical_topk, mention_tags,
    ]
} | {
    "session_status": status_of_sessions,
    "current_assignments": _current_assignments,
    "skill_rank": lambda t: t.model("f_ondemand_skills"),
    "sessions_final": lambda t: t.model("f_sessions_final"),
    "team_sessions_final": team_sessions_final,
    "score": score,
}
MARTS = {"f_sessions_final", "f_team_sessions_final", "f_score"}


# Models that queries ask for, and how many times they read them where it is not once.
READS: dict[str, dict[str, int]] = {
    "latest_archived_hidden": {"d_users": 1},
    "best_score_lookup": {"m_session_learner": 2, "m_client_user_role": 2, "f_live_skills": 1},
    "tagged_union_sessions": {"m_session_learner": 2, "m_client_user_role": 2, "f_session_score": 2},
    "routing_join": {"f_ondemand_skills": 2, "f_live_skills": 2, "f_sessions_final": 1},
    "routing_join_split": {"f_ondemand_skills": 2, "f_live_skills": 2, "f_sessions_final": 1},
    "user_client_roles": {"m_client_user_role": 2},
    "current_assignments": {"m_client_user_role": 2, "m_team_member": 2, "m_scenario_team": 2},
    "anti_history": {"m_client_user_role": 2, "m_team_member": 2, "m_scenario_team": 2, "f_sessions_final": 1},
    "one_team_per_pair": {"f_sessions_final": 1, "m_client_user_role": 1},
    "check_declared": {name: 1 for name in CHECKS},
    **{name: {name: 1} for name in MODELS},
    "skill_rank": {"f_ondemand_skills": 1}, "sessions_final": {"f_sessions_final": 1},
    "team_sessions_final": {"f_team_sessions_final": 1}, "score": {"f_score": 1},
    "attempt_numbers": {"f_sessions_final": 1}, "attempt_numbers_ranged": {"f_sessions_final": 1},
    "competency_attempts": {"f_live_skills": 1}, "proficiency_ladder": {"f_live_skills": 1},
    "mindset_types": {"m_skill_score_mindset": 1},
}


# Columns that queries use of models they share, where those have many more: what is written, and shuffled for it, has these only.
TEAM_SESSIONS_USE = {"f_sessions_final": ["id", "scenario_id", "learner_id", "session_type", *marts.SESSION_COLUMNS]}
USED: dict[str, dict[str, Sequence[str]]] = {
    "routing_join": {"f_live_skills": ["sessionid", "event_number", "skill_id"]},
    "routing_join_split": {"f_live_skills": ["sessionid", "event_number", "skill_id"]},
    "team_sessions_final": TEAM_SESSIONS_USE,
    "score": TEAM_SESSIONS_USE | {
        "f_live_skills": [
            "sessionid", "event_number", "skill_id", "skill_name", "skill_score", "score", "mindset_type", "old_skill_name",
        ],
    },
}


def _over(name: str, query: Callable[[Trial], DataFrame]) -> Query:
    return lambda spark, folder: query(Trial(spark, folder, USED.get(name), **READS.get(name, {})))


def entry(spark: SparkSession) -> DataFrame:
    """The widest mart, on the smallest tables."""
    return queries()["score"](spark, "/root/testdata/sf0.001")


@cache
def queries() -> dict[str, Query]:
    """Every warehouse model under its name, then the operators and marts."""
    models = {name: _over(name, lambda t, name=name: t.model(name)) for name in MODELS if name not in MARTS}
    return models | {name: _over(name, query) for name, query in QUERIES.items()} | _document_queries()[0]


def oracle_sql() -> dict[str, str]:
    return SQL | _document_queries()[1]


@cache
def _document_queries() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the operators on documents, and of their pipeline, where those are installed."""
    found, sql = {}, {}
    if find_spec("rosterlens.llm"):
        from rosterlens.llm import queries as documents

        found, sql = documents.QUERIES, documents.SQL
        if find_spec("corpus_pipeline"):
            import corpus_pipeline

            found = found | {"pipeline": corpus_pipeline.run}
            sql = sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return found, sql
