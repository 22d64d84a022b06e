"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from compare import database, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


# The operators on documents have tests of their own.
NAMES = [n for n in entry.queries() if n not in entry._document_queries()[0]]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    count, wrong = difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert wrong is None
    assert count > 0


def test_every_query_has_sql():
    assert set(NAMES) <= entry.oracle_sql().keys()


def test_build_job(spark, tmp_path):
    from rosterlens.plans.build import DISABLED, MODELS, VIEWS, build_all, check_all
    from rosterlens.sources.shaping import SHAPES, tables_in

    tables = tables_in(spark, FOLDER)
    raw = {name: shape(tables) for name, shape in SHAPES.items()}
    built = build_all(spark, raw, str(tmp_path), options=entry.OPTIONS)
    assert built.keys() == MODELS.keys() - DISABLED
    assert set(os.listdir(tmp_path)) == built.keys() - VIEWS
    assert spark.table("m_session_learner").count() > 0
    assert built["f_score"].count() == 6716
    failing = {(r.table, r.columns): r.failing_rows for r in check_all(built).collect() if r.failing_rows}
    # Skill scores that belong to no session.
    assert failing.keys() == {("f_ondemand_skills", "sessionid")}


def test_catalog_build_keeps_descriptions_and_metadata(spark):
    from rosterlens.plans.build import build_all
    from rosterlens.sources.shaping import SHAPES, tables_in

    tables = tables_in(spark, FOLDER)
    spark.sql("CREATE DATABASE IF NOT EXISTS built")
    built = build_all(spark, {n: shape(tables) for n, shape in SHAPES.items()}, "catalog:built", options=entry.OPTIONS)
    assert spark.table("built.f_score").count() == built["f_score"].count() == 6716
    props = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES built.d_client").collect()}
    assert props["meta.owner"] == "analytics" and props["meta.pii"] == "false"
    rows = spark.sql("DESCRIBE EXTENDED built.d_client").collect()
    assert any(r.col_name == "Comment" and "raw_client" in r.data_type for r in rows)
    assert any(r.col_name == "row_number" and r.comment for r in rows)
