"""Raw tables: what they are called, what they hold and how to read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The declared raw tables with their descriptions.
RAW_TABLES = {
    "raw_session": "Raw session data from production",
    "raw_scenario": "Scenario data from production",
    "raw_users": "Raw user data from production",
    "raw_session_learner": "Session learner mapping data from production",
    "raw_client_user_role": "Client user role mapping data from production",
    "raw_scenario_building_block": "Scenario building block data from production",
    "raw_events_mindset": "Events mindset data from production",
    "raw_project": "Raw project data from production",
    "raw_ondemand_session": "On-demand session data from production",
    "raw_scenario_team": "Scenario team mapping data from production",
    "raw_ondemand_session_event": "On-demand session event data from production",
    "raw_building_blocks": "Building blocks data from production",
    "raw_team": "Team data from production",
    "raw_client": "Client data from production",
    "raw_client_user": "Client user data from production",
    "raw_industry": "Industry data from production",
    "raw_skill_score": "Skill score data from production",
    "raw_session_score": "Session score data from production",
    "raw_team_member": "Team member data from production",
    "raw_sim_feedback": "Sim feedback data from production",
    "raw_scenario_bank_event_scoring": "Scenario bank event data",
    "raw_scenario_goals": "Scenario goals data from production",
    "raw_skill_domain_mapping": "Skill domain mapping data from production",
    "raw_post_simulation": "Post simulation data from production",
    "raw_session_learner_report": "Session learner report data from production",
    "raw_events": "Events data from production",
    "raw_events_assessment": "Events assessment data from production",
    "raw_session_insights_service": "Session insights service data from production",
}


def read_raw(spark: SparkSession, source: str, name: str) -> DataFrame:
    """A raw table as it lies: `source` is a folder of Parquet tables, or `catalog:<schema>`."""
    if name not in RAW_TABLES:
        raise KeyError(f"{name} is not a declared raw table")
    if source.startswith("catalog:"):
        return spark.table(f"{source.removeprefix('catalog:')}.{name}")
    return spark.read.parquet(f"{source.rstrip('/')}/{name}")
