"""Refusals on the governed path and truthful remediation."""

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import ddl, masking as fm
from lakewarden.functions import text as gates
from lakewarden.operators.mask import UnmappedColumns
from lakewarden.plans import governed
from lakewarden.plans.domain import clinical_contract
from lakewarden.plans.intent import Intent, run_intent
from lakewarden.sources import catalog, raw

CONTRACT = clinical_contract()


@pytest.fixture(scope="module")
def patients(spark):
    columns = [c.column for c in CONTRACT.table("patients").columns]
    rows = spark.range(30).select(*[F.concat(F.lit(c + "-"), F.col("id").cast("string")).alias(c) for c in columns])
    governed.register_governed({"patients": rows}, prefix="r_")
    return rows


def sql(spark, statement, **options):
    return governed.governed_sql(spark, statement, CONTRACT, "analyst", fm.secret(spark, "k"), **options)


@pytest.mark.parametrize("between", ["/* ' */ UNION ALL", "-- '\n UNION ALL", "WHERE length(\"'\") = 1 UNION ALL", "WHERE r'\\' <> '' UNION ALL"])
def test_hidden_set_operators_are_refused(spark, patients, between):
    tail = "SELECT first FROM r_patients WHERE id <> ''"
    with pytest.raises(governed.Blocked):
        sql(spark, f"SELECT gender FROM r_patients {between} {tail}")


def test_literals_and_comments_are_taken_in_order(spark):
    texts = ["SELECT 'a -- b' FROM t", "SELECT 1 /* ' */ UNION SELECT 2", "SELECT ' UNION '", "SELECT \" UNION \"", "SELECT 'a\\' UNION '"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(gates.combines_sets(F.col("s")))
    assert [r[0] for r in df.collect()] == [False, True, False, False, False]


def test_derived_texts_are_refused_and_numbers_pass(spark, patients):
    with pytest.raises(governed.Blocked):
        sql(spark, "SELECT upper(first) AS n FROM r_patients", derived=("n",))
    assert sql(spark, "SELECT count(*) AS n FROM r_patients", derived=("n",)).rows.first()[0] == 30


def test_renamed_columns_are_masked_by_their_origin(spark, patients):
    key = fm.secret(spark, "k")
    result = governed.govern(patients.select(F.col("first").alias("who"), F.col("first").alias("county")), CONTRACT, "analyst", key)
    assert {tuple(r) for r in result.rows.collect()} == {("***REDACTED***", "***REDACTED***")}
    with pytest.raises(UnmappedColumns):
        governed.govern(patients.select(F.upper("first").alias("who")), CONTRACT, "analyst", key)


@pytest.mark.parametrize("shown", ["upper(first) AS county", "cast(regexp_extract(id, '[0-9]+', 0) AS BIGINT) AS n", "length(first) AS n", "first || 'x' AS gender"])
def test_computed_from_masked_is_refused_whatever_its_name(spark, patients, shown):
    for options in ({}, {"derived": ("n",)}):
        with pytest.raises((UnmappedColumns, governed.Blocked)):
            sql(spark, f"SELECT {shown} FROM r_patients", **options)


@pytest.mark.parametrize(
    "statement, clear",
    [
        ("SELECT first FROM r_patients UNION ALL SELECT first FROM r_patients WHERE id > 'x'", False),
        ("WITH t AS (SELECT first AS a FROM r_patients) SELECT a AS gender FROM t", False),
        ("SELECT count(*) AS first_visits, count(DISTINCT first) AS names FROM r_patients", True),
        ("SELECT row_number() OVER (ORDER BY first) AS place FROM r_patients", True),
        ("-- a comment ; with 'marks\nSELECT 'UPDATE' AS note, count(*) AS n FROM r_patients", True),
        ("SELECT (SELECT count(*) FROM r_patients) AS n", True),
    ],
)
def test_statements_get_the_verdict_of_their_plan(spark, patients, statement, clear):
    values = {v for r in sql(spark, statement).rows.collect() for v in r}
    assert ("***REDACTED***" in values) != clear and not any(str(v).startswith("first-") for v in values)


def test_sums_of_masked_numbers_need_a_voucher(spark):
    people = spark.range(20).select(F.col("id").cast("string").alias("id"), (F.col("id") * 1.5).alias("first"))
    governed.register_governed({"patients": people}, prefix="s_")
    with pytest.raises(UnmappedColumns):
        sql(spark, "SELECT avg(first) AS mean FROM s_patients")
    assert sql(spark, "SELECT avg(first) AS mean FROM s_patients", derived=("mean",)).rows.first()[0] == 14.25


def test_pages_of_targeted_results_add_up(spark, patients, tmp_path):
    role = next(r for r in CONTRACT.roles if CONTRACT.role(r).phi_access == "TARGETED_ONLY")
    key, log = fm.secret(spark, "k"), f"{tmp_path}/log"

    def page(limit, offset):
        statement = f"SELECT id, first FROM r_patients ORDER BY id LIMIT {limit} OFFSET {offset}"
        result = governed.governed_sql(spark, statement, CONTRACT, role, key, audit_path=log, run_id=f"{offset}")
        return result.targeted, {r["first"] for r in result.rows.collect()} == {"***REDACTED***"}

    assert page(6, 0) == (True, False)
    assert page(6, 0) == (True, False)  # the same entities again
    assert page(4, 6) == (True, False)  # ten in all
    assert page(1, 10) == (False, True)
    assert page(10, 10) == (False, True)
    assert page(10, 0) == (True, False)


def test_a_cut_result_is_never_targeted(spark, patients):
    for role in CONTRACT.roles:
        if CONTRACT.role(role).phi_access == "TARGETED_ONLY":
            result = governed.govern(patients, CONTRACT, role, fm.secret(spark, "k"), limit=10)
            assert result.truncated and not result.targeted


def test_groups_are_complete_without_a_limit(spark):
    frames = {"patients": spark.range(150).select(F.col("id").cast("string").alias("id"), F.col("id").alias("city"))}
    assert run_intent(Intent("aggregate", ("patients",), group_by=("city",)), frames).count() == 150
    assert run_intent(Intent("aggregate", ("patients",), group_by=("city",), limit=7), frames).count() == 7


def test_statement_names_its_own_target(spark):
    cases = {
        "ALTER TABLE lake.raw.patients ADD COLUMNS (x STRING)": True,
        "ALTER TABLE `raw`.`patients` ADD COLUMNS (x STRING)": True,
        "ALTER TABLE lake.raw.patients_backup ADD COLUMNS (x STRING)": False,
        "ALTER TABLE lake.raw.other ADD COLUMNS (patients STRING)": False,
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    verdict = ddl.statement_verdict(F.col("s"), F.lit("patients"), F.lit("lake.raw.patients"), F.lit("autonomous"))
    assert [r[0] for r in df.select(verdict["ok"]).collect()] == list(cases.values())


def test_only_absent_columns_are_added(spark):
    spark.sql("DROP TABLE IF EXISTS part_added")
    spark.range(2).selectExpr("id as a", "id as b").write.saveAsTable("part_added")
    statement = "ALTER TABLE part_added ADD COLUMNS (b BIGINT, c STRUCT<x: INT, y: INT> COMMENT 'one, two', `d` STRING)"
    assert catalog.add_columns(spark, "part_added", statement)["reason"] == "applied"
    assert spark.table("part_added").columns == ["a", "b", "c", "d"]
    assert catalog.add_columns(spark, "part_added", statement)["reason"] == "already exists"
    spark.sql("DROP TABLE part_added")


def test_all_among_named_tables():
    assert raw.parse_table_filter("orders, all", ["a", "b"]) == ["a", "b", "orders"]


def test_parts_with_other_columns_fail_the_scan(spark, tmp_path):
    for name, lines in (("p1.csv", "id,customer\n1,10\n"), ("p2.csv", "customer,id\n20,2\n")):
        (tmp_path / name).write_text(lines)
    with pytest.raises(Exception, match="(?i)header"):
        raw.scan_text(spark, str(tmp_path)).collect()
