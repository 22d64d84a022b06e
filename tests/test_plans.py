"""What the physical plans must look like."""

import os
import re

import pytest

import __spark_entry__ as entry
from rosterlens.plans import marts
from rosterlens.plans.build import MODELS, inputs
from rosterlens.sources.shaping import SHAPES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name):
    return plan_of(entry.queries()[name](spark, FOLDER))


def read_columns(text):
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*?)>", text)]


def test_scans_read_only_what_is_used(spark):
    [keys] = read_columns(plan(spark, "check_unique_combo"))
    assert keys == {"l_orderkey", "l_linenumber"}
    assert plan(spark, "check_unique_combo").count("Exchange hashpartitioning") == 1
    assert plan(spark, "latest_by_revision").count("Exchange hashpartitioning") == 1
    assert read_columns(plan(spark, "html_clean_pages")) == [{"page_id", "html"}]
    [columns] = read_columns(plan(spark, "latest_by_revision"))
    assert len(columns) == 9 and "l_returnflag" not in columns


@pytest.fixture
def trial(spark):
    return entry.Trial(spark, FOLDER)


def test_filters_of_the_score_mart_reach_the_scan(spark):
    names = inputs("f_score")
    written = entry.Trial(spark, FOLDER, f_team_sessions_final=2)
    text = plan_of(marts.scored_rows(**{n: written[n] for n in names}))
    [scan] = {s for s in re.findall(r"PushedFilters: \[(.*?)\]", text) if "user_role" in s}
    assert "EqualTo(user_role,learner)" in scan and "EqualTo(scenario_generation_type,1)" in scan
    assert not {"first_name", "last_name", "email", "full_name"} & set().union(*read_columns(text))


def test_models_start_no_job(spark, trial):
    """With their inputs at hand, making a model is making a plan."""
    shaped = {name: trial[name] for name in SHAPES}
    tables = dict(shaped)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("models", "models")
    for name, model in MODELS.items():
        tables[name] = model(**{t: tables[t] for t in inputs(name)}, **entry.OPTIONS.get(name, {}))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert list(tracker.getJobIdsForGroup("models")) == []


def test_historical_pairs_come_from_an_anti_join(spark):
    assert "FullOuter" not in plan(spark, "anti_history")


@pytest.mark.parametrize("name", ["d_client", "f_live_session", "latest_by_revision", "f_session_score"])
def test_current_rows_are_cut_down_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") == 2


def test_archived_rows_are_dropped_after_ranking(spark):
    text = plan(spark, "d_client")
    assert text.index("NOT archived") < text.index("WindowGroupLimit")


def test_pivot_adds_no_shuffle_and_no_grouping(spark):
    text = plan(spark, "d_post_simulation")
    assert "Aggregate" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_slots_come_from_one_scan(spark):
    text = plan(spark, "slot_unpivot")
    assert sum("o_orderkey" in c for c in read_columns(text)) == 1
    assert "Generate inline" in text


@pytest.mark.parametrize("name", [
    "f_live_skills", "user_client_roles", "current_assignments", "lexical_topk", "mention_tags",
    "tagged_union_sessions", "one_team_per_pair", "anti_history",
])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(spark, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert word not in text


@pytest.mark.parametrize("few_pairs", [0, 8])
def test_search_reads_the_documents_once_and_ranks_before_the_shuffle(spark, monkeypatch, few_pairs):
    """Postings are written from one scan; what is left of the plan reads texts for boosted documents alone."""
    monkeypatch.setattr(entry.search, "FEW_PAIRS", few_pairs)
    text = plan(spark, "lexical_topk")
    assert sum({"doc_id", "text"} <= c for c in read_columns(text)) <= 1
    assert text.count("WindowGroupLimit") == 2
    dealt = re.findall(r"Exchange hashpartitioning\((.*?)\)", text)
    # Without few pairs all postings are scored where they are; few pairs may travel.
    assert few_pairs or [d for d in dealt if "doc_id" in d and "query_id" in d] == []


def test_each_right_side_is_derived_once(spark):
    """Keys were sketched when the tables were written, so no plan counts them, or reads a side twice for it."""
    text = plan(spark, "team_sessions_final")
    assert text.count("FileScan") <= 40
    assert "approx_top_k" not in text and "_parts" not in text


def test_checks_read_each_table_once(spark):
    text = plan(spark, "check_declared")
    assert text.count("Expand ") <= 31
    tables = entry.CHECKS.keys()
    # Of each checked table: one shuffle by its keys, and what its model needs.
    assert len(tables) == 31 and text.count("grouping_id") + text.count("spark_grouping_id") > 0


def test_only_shared_tables_are_written(spark):
    """A model that a query reads once stays a plan."""
    assert entry.shared_tables({"f_session_score": 1}) == set()
    assert "f_sessions_final" in entry.shared_tables({"f_score": 1})
    [columns] = read_columns(plan(spark, "earliest_created_score"))
    assert len(columns) <= 12


def test_answers_are_folded_once(spark):
    """One expression over the entries, whatever the number of questions."""
    text = plan(spark, "d_post_simulation")
    assert text.count("aggregate(") <= 3
