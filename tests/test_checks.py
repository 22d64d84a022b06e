from conftest import as_set

from rosterlens.operators.checks import AcceptedValues, NotNull, Unique, UniqueCombination, check_table
from rosterlens.plans.build import CHECKS, DISABLED, MODELS, check_all

ROWS = [("a", 1, "0"), ("a", 2, "1"), (None, 3, "1"), (None, 3, None), ("b", 4, "2")]
SCHEMA = "k string, n int, f string"


def test_every_kind(frame):
    checks = [
        Unique("k"), NotNull("k"), AcceptedValues("f", ("0",)), UniqueCombination(("k", "n")),
        NotNull("n"), NotNull("f"),
    ]
    assert as_set(check_table(frame(ROWS, SCHEMA), checks)) == {
        ("unique", "k", 1), ("not_null", "k", 2), ("accepted_values", "f", 2),
        ("unique_combination", "k, n", 1), ("not_null", "n", 0), ("not_null", "f", 1),
    }


def test_numbers_are_compared_as_text(frame):
    assert check_table(frame([(0,), (1,)], "f int"), [AcceptedValues("f", ("0",))]).first()[2] == 1


def test_empty_table_passes(frame):
    out = check_table(frame([], SCHEMA), [Unique("k"), NotNull("k"), NotNull("n")])
    assert {r.failing_rows for r in out.collect()} == {0}


def test_one_pass_for_null_checks(frame):
    plan = check_table(frame(ROWS, SCHEMA), [NotNull("k"), NotNull("n")])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_all_sets_of_a_table_share_a_scan_and_a_shuffle(spark, frame, tmp_path):
    frame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    checks = [
        Unique("k"), Unique("n"), NotNull("k"), NotNull("f"), AcceptedValues("k", ("a",)), UniqueCombination(("k", "n")),
        UniqueCombination(("n", "k")),
    ]
    out = check_table(spark.read.parquet(str(tmp_path / "t")), checks)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Expand") == 1
    assert as_set(out) == {
        ("unique", "k", 1), ("unique", "n", 1), ("not_null", "k", 2), ("not_null", "f", 1), ("accepted_values", "k", 1),
        ("unique_combination", "k, n", 1), ("unique_combination", "n, k", 1),
    }


def test_nulls_of_the_table_are_not_those_of_the_sets(frame):
    """Columns outside a set are NULL in its groups, which is no NULL of the table."""
    out = check_table(frame([("a", 1), ("b", 2)], "k string, n int"), [Unique("k"), Unique("n"), NotNull("k"), NotNull("n")])
    assert {r.failing_rows for r in out.collect()} == {0}
    out = check_table(frame([(None, None)] * 3, "k string, n int"), [UniqueCombination(("k", "n")), Unique("k"), NotNull("n")])
    assert as_set(out) == {("unique_combination", "k, n", 1), ("unique", "k", 0), ("not_null", "n", 3)}


def test_declarations():
    kinds = [type(c).__name__ for checks in CHECKS.values() for c in checks]
    assert len(kinds) == 72 and len(CHECKS) == 31
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "Unique": 25, "NotNull": 40, "AcceptedValues": 1, "UniqueCombination": 6,
    }
    assert CHECKS.keys() <= MODELS.keys() and DISABLED <= CHECKS.keys()


def test_check_on_a_missing_column_is_reported(frame):
    out = check_all({"f_skill_domain_name": frame([("s",)], "skill_id string")})
    assert as_set(out) == {
        ("f_skill_domain_name", "unique", "id", None), ("f_skill_domain_name", "not_null", "id", None),
    }
