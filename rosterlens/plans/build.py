"""Building all tables and checking them."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import session_column
from ..operators.heavy import KeySketches
from ..operators.checks import (
    AcceptedValues, Check, NotNull, Unique, UniqueCombination, check_table, columns_of, kind_of,
)
from ..sources.raw import RAW_TABLES, read_raw
from ..sources.sinks import describe_table, write_table
from ..sources.staging import stage, staging_folder, staging_run
from . import marts, warehouse

# Every model after those it reads.
MODELS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in [
        warehouse.d_client, warehouse.d_users, warehouse.d_team, warehouse.d_industry,
        warehouse.d_project, warehouse.d_scenario, warehouse.d_building_blocks, warehouse.d_events,
        warehouse.d_scenario_goals, warehouse.d_scenario_bank_event_scoring,
        warehouse.d_learner_confidence, warehouse.d_post_simulation,
        warehouse.f_live_session, warehouse.f_ondemand_session, warehouse.f_ondemand_session_event,
        warehouse.f_session_score, warehouse.f_skill_score, warehouse.f_skill_domain_mapping,
        warehouse.f_events_assessment, warehouse.f_events_mindset,
        warehouse.f_session_insights_service,
        warehouse.m_user_client, warehouse.m_client_user_role, warehouse.m_team_member,
        warehouse.m_scenario_team, warehouse.m_scenario_building_block,
        warehouse.m_session_learner, warehouse.m_skill_score_mindset,
        warehouse.f_live_skills, warehouse.f_ondemand_skills, warehouse.f_skill_domain_name,
        marts.f_sessions_final, marts.f_team_sessions_final, marts.f_score,
    ]
}
VIEWS = {
    "f_ondemand_session", "f_ondemand_session_event", "m_scenario_team", "m_session_learner",
    "m_skill_score_mindset",
}
DISABLED = {"f_skill_domain_name"}
# Keys by which later models look a table up: those with many rows are sketched when it is written.
SESSION = "<session>"
LOOKUP_KEYS: dict[str, list[tuple[str, ...]]] = {
    "m_client_user_role": [("user_id",)],
    "m_session_learner": [("session_id",)],
    "m_skill_score_mindset": [("mindset_id",)],
    "m_team_member": [("user_role_id",)],
    "m_scenario_team": [("team_id",)],
    "f_session_score": [("sessionid",)],
    "f_ondemand_skills": [("sessionid",)],
    "f_live_skills": [(SESSION,)],
    "f_sessions_final": [("learner_id", "scenario_id"), ("scenario_id",)],
    "d_scenario_bank_event_scoring": [("scenario_id",)],
}
# What is kept with every table.
META = {"owner": "analytics", "pii": False}
CATALOG = "catalog:"


def watched(keys: KeySketches, name: str, df: DataFrame) -> DataFrame:
    """`df` as it is, its lookup keys sketched while it is written."""
    found = [tuple(session_column(df) if c == SESSION else c for c in on) for on in LOOKUP_KEYS.get(name, ())]
    return keys.watch(name, df, found)


# What models number, and by which groups: written first, its groups sketched, and numbered from there.
NUMBERED: dict[str, tuple[Callable[..., DataFrame], Callable[..., DataFrame], tuple[str, ...]]] = {
    "f_ondemand_skills": (warehouse.ondemand_skill_scores, warehouse.ranked_skills, ("sessionid",)),
    "f_score": (marts.scored_rows, marts.numbered_scores, ("user_id",)),
}

ORDERED = {"f_score": ("user_id", "session_id", "team_id", "client_user_role_id")}

# Feeds of links that a model counts, walks and looks up: read once, and staged with these columns.
LINKS: dict[str, dict[str, tuple[str, ...]]] = {
    "f_team_sessions_final": {
        "raw_team_member": ("user_role_id", "team_id"), "raw_scenario_team": ("scenario_id", "team_id"),
    },
}


def make(
    name: str, tables: Mapping[str, DataFrame], keys: KeySketches, options: Mapping[str, object] | None = None,
    staged: bool = True,
) -> DataFrame:
    """A model from its tables. What it numbers, and link feeds, are staged first, unless the whole is to stay a plan."""
    options = dict(options or {})
    read = {t: tables[t] for t in inputs(name)}
    if staged:
        read |= {t: stage(read[t].select(*columns).distinct()) for t, columns in LINKS.get(name, {}).items()}

    def written(rows: DataFrame) -> DataFrame:
        return stage(keys.watch(marts.WRITTEN_PARTS[name], rows, [("scenario_id",)]))

    if staged and name in NUMBERED:
        rows_of, number, groups = NUMBERED[name]
        own = {k: v for k, v in options.items() if k in inspect.signature(rows_of).parameters}
        rest = {k: v for k, v in options.items() if k not in own}
        takes = inspect.signature(rows_of).parameters
        spark = next(iter(read.values())).sparkSession
        kept = staging_folder(spark)
        with staging_run(spark):  # what is staged on the way goes once the rows are written
            more = {k: v for k, v in {"keys": keys, "written": written}.items() if k in takes}
            rows = keys.watch(f"rows of {name}", rows_of(**read, **own, **more), [groups], nulls=True)
            # In the order of their groups rows take less room, here and in the shuffle that they are numbered from.
            if name in ORDERED:
                rows = rows.sortWithinPartitions(*ORDERED[name])
            rows = stage(rows, kept, by_one_key=name in marts.WRITTEN_PARTS and marts.dealt_by_scenario(keys, marts.WRITTEN_PARTS[name]))
        return number(rows, heavy=keys.of(f"rows of {name}", *groups), **rest)
    takes = inspect.signature(MODELS[name]).parameters
    more = {k: v for k, v in {"keys": keys, **({"written": written} if staged else {})}.items() if k in takes}
    return MODELS[name](**read, **more, **options)


def comment_of(model: str) -> str:
    """What a model is and what it is made from."""
    doc = (MODELS[model].__doc__ or "").strip().split("\n")[0]
    kind = {"d": "Dimension", "m": "Bridge", "f": "Fact"}[model[0]]
    return f"{doc or kind} Built from {', '.join(inputs(model))}." if doc else f"{kind} built from {', '.join(inputs(model))}."


def column_comments(df: DataFrame) -> dict[str, str]:
    return {"row_number": "Rank of the row among the versions of its key; 1 is the current one."} if "row_number" in df.columns else {}


def inputs(model: str) -> list[str]:
    """The tables a model reads: its parameters without a default."""
    return [
        name for name, p in inspect.signature(MODELS[model]).parameters.items()
        if p.default is inspect.Parameter.empty
    ]


def build_all(
    spark: SparkSession,
    raw: str | Mapping[str, DataFrame],
    out: str,
    options: Mapping[str, Mapping[str, object]] | None = None,
    with_disabled: bool = False,
) -> dict[str, DataFrame]:
    """Rebuild every model from the raw tables and return them as DataFrames.

    Tables are written under the folder `out`, or into a schema named `catalog:<schema>` with their
    descriptions and metadata, and read back, so each is computed once and later models scan only the columns
    they use. Views are registered and stay lazy. `options` holds further arguments per model, such as
    other clients to fan out. What is staged on the way is removed at the end.
    """
    tables = (
        {name: read_raw(spark, raw, name) for name in RAW_TABLES}
        if isinstance(raw, str) else dict(raw)
    )
    schema = out.removeprefix(CATALOG) if out.startswith(CATALOG) else None
    built, keys = {}, KeySketches()
    with staging_run(spark):
        for name in MODELS:
            if name in DISABLED and not with_disabled:
                continue
            df = make(name, tables, keys, (options or {}).get(name))
            if name in VIEWS:
                df.createOrReplaceTempView(name)
                built[name] = df
                # Views that are looked up are written for this build alone.
                tables[name] = stage(watched(keys, name, df)) if name in LOOKUP_KEYS else df
                continue
            to = f"{schema}.{name}" if schema else f"{out.rstrip('/')}/{name}"
            write_table(
                watched(keys, name, df), to, order=["session_id"] if name == "f_score" else (), table=bool(schema)
            )
            if schema:
                describe_table(spark, to, comment_of(name), column_comments(df), META)
            tables[name] = built[name] = spark.table(to) if schema else spark.read.parquet(to)
    return built


def _key(column: str) -> list[Check]:
    return [Unique(column), NotNull(column)]


def _keys(*columns: str) -> list[Check]:
    return [UniqueCombination(columns), *map(NotNull, columns)]


# The declared checks. SESSION stands for the survey's session id column.
CHECKS: dict[str, list[Check]] = {
    "d_building_blocks": _key("id"),
    "d_client": _key("id"),
    "d_events": _key("id"),
    "d_industry": _key("id"),
    "d_learner_confidence": _key("session_id"),
    "d_post_simulation": _key(SESSION),
    "d_project": _key("id"),
    "d_scenario": _key("id"),
    "d_scenario_bank_event_scoring": _key("id"),
    "d_scenario_goals": _keys("scenario_id", "goal_index"),
    "d_team": _key("id"),
    "d_users": _key("id"),
    "f_events_assessment": _key("id"),
    "f_events_mindset": _key("id"),
    "f_live_session": _key("id"),
    "f_live_skills": _keys(SESSION, "skill_id", "event_number"),
    "f_ondemand_session": _key("id"),
    "f_ondemand_session_event": _key("id"),
    "f_ondemand_skills": _keys("sessionid", "skill", "rn"),
    "f_session_insights_service": _key("id"),
    "f_session_score": _key("id"),
    "f_skill_domain_mapping": _key("skill_id"),
    # Declared on a column the model does not have; kept so that it is reported, see check_all.
    "f_skill_domain_name": _key("id"),
    "f_skill_score": _key("id"),
    "m_client_user_role": _key("id"),
    "m_scenario_building_block": _key("id"),
    "m_scenario_team": _keys("scenario_id", "team_id"),
    "m_session_learner": [
        *_keys("session_id", "user_role_id"),
        NotNull("has_d_value"), AcceptedValues("has_d_value", ("0",)),
    ],
    "m_skill_score_mindset": _key("events_mindset_id"),
    "m_team_member": _keys("team_id", "user_role_id"),
    "m_user_client": _key("id"),
}


def _for_table(check: Check, df: DataFrame) -> Check:
    """The check with the session id column's real name in place of SESSION."""
    def real(column: str) -> str:
        return session_column(df) if column == SESSION else column

    if isinstance(check, UniqueCombination):
        return replace(check, columns=tuple(map(real, check.columns)))
    return replace(check, column=real(check.column))


def check_all(
    tables: Mapping[str, DataFrame], checks: Mapping[str, list[Check]] = CHECKS
) -> DataFrame:
    """(table, check, columns, failing_rows) for all declared checks on the given tables.

    A check on a column the table lacks cannot run and shows NULL failing rows.
    """
    parts = []
    for name in checks.keys() & tables.keys():
        df = tables[name]
        declared = [_for_table(c, df) for c in checks[name]]
        able = [c for c in declared if set(columns_of(c)) <= set(df.columns)]
        if able:
            parts.append(check_table(df, able).select(F.lit(name).alias("table"), "*"))
        for c in declared:
            if c not in able:
                parts.append(
                    df.sparkSession.range(1).select(
                        F.lit(name).alias("table"),
                        F.lit(kind_of(c)).alias("check"),
                        F.lit(", ".join(columns_of(c))).alias("columns"),
                        F.lit(None).cast("long").alias("failing_rows"),
                    )
                )
    return reduce(DataFrame.unionByName, parts)
