"""Ingestion, remediation, file arrival, catalog writes and governed queries, end to end."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import masking as fm
from lakewarden.operators import mask, reports
from lakewarden.plans import governed, ingest
from lakewarden.plans.domain import clinical_contract
from lakewarden.sources import catalog, raw
from lakewarden.sources import contract as contracts
from lakewarden.streaming.arrival import start_arrivals

CONTRACT = clinical_contract()
HEADS = {
    "allergies": "START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION",
    "immunizations": "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION",
}


def write_csv(folder, table, head, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{table}.csv", "w") as f:
        f.write("\n".join([head, *lines]) + "\n")


@pytest.fixture
def database(spark, tmp_path):
    name = f"d{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/catalog'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def run(spark, folder, base, database, tables, contract=CONTRACT, **options):
    manifest = ingest.preflight(spark, folder, contract, tables, options.pop("on_critical", "halt"))
    writes = ingest.write_ready(spark, manifest, contract, base, database, **options)
    final = {r["table"]: r for r in ingest.finish(manifest, writes).collect()}
    return manifest, writes, final


def test_clean_run(spark, tmp_path, database):
    folder, base = f"{tmp_path}/raw", f"{tmp_path}/tables"
    write_csv(folder, "allergies", HEADS["allergies"], ["2020-01-15,,p1,e1,1,Peanut", "bad,2020-02-01,p2,e2,2,"])
    write_csv(folder, "unlisted", "a,b", ["1,x", "2,y"])
    manifest, writes, final = run(spark, folder, base, database, ["allergies", "unlisted", "absent"])
    assert {t: r["status"] for t, r in final.items()} == {"allergies": "OK", "unlisted": "OK", "absent": "SKIPPED"}
    rows = spark.table(f"{database}.allergies").orderBy("patient").collect()
    assert rows[0]["start"] == dt.date(2020, 1, 15) and rows[1]["start"] is None
    assert final["allergies"]["row_count"] == 2
    shares = {r["table"]: r["null_pct"] for r in writes.collect()}
    assert shares["allergies"]["start"] == 50.0 and shares["allergies"]["patient"] == 0.0
    assert dict(spark.table(f"{database}.unlisted").dtypes)["a"] == "int"


@pytest.mark.parametrize(
    "head, line, kind, status",
    [
        (HEADS["immunizations"] + ",blood_type", "2020-01-01,p,e,1,x,A", "new", "BLOCKED_CRITICAL_DRIFT"),
        ("DATE,PATIENT,ENCOUNTER,CODE", "2020-01-01,p,e,1", "missing", "BLOCKED_CRITICAL_DRIFT"),
    ],
)
def test_drift_blocks_or_falls_back(spark, tmp_path, database, head, line, kind, status):
    folder, base = f"{tmp_path}/raw", f"{tmp_path}/tables"
    write_csv(folder, "immunizations", head, [line])
    _, _, final = run(spark, folder, base, database, ["immunizations"])
    assert final["immunizations"]["status"] == status
    assert final["immunizations"]["drift_severity"] == "CRITICAL"
    assert not catalog.table_exists(spark, f"{database}.immunizations")
    _, _, forced = run(spark, folder, base, database, ["immunizations"], on_critical="fallback")
    assert forced["immunizations"]["status"] == "OK"
    _, _, dry = run(spark, folder, base, database, ["immunizations"], on_critical="fallback", dry_run=True)
    assert dry["immunizations"]["status"] == "DRY_RUN"


def test_type_change_matrix(spark):
    """A changed type shows in the schema diff of uncast input."""
    incoming = spark.createDataFrame([], "date int, patient string, encounter string, code string, description string")
    items = ingest.drift_items({"immunizations": incoming}, CONTRACT).collect()
    assert [(i["column"], i["drift"], i["severity"]) for i in items] == [("date", "type_change", "CRITICAL")]


def test_additive_remediation_then_rerun(spark, tmp_path, database):
    folder, base = f"{tmp_path}/raw", f"{tmp_path}/tables"
    write_csv(folder, "immunizations", HEADS["immunizations"], ["2020-01-01,p,e,1,x"])
    run(spark, folder, base, database, ["immunizations"])
    write_csv(folder, "immunizations", HEADS["immunizations"] + ",blood_type", ["2020-01-01,p,e,1,x,A"])
    manifest, _, final = run(spark, folder, base, database, ["immunizations"])
    assert final["immunizations"]["status"] == reports.BLOCKED
    versions = CONTRACT.rows(spark)
    now = dt.datetime(2024, 2, 1)
    outcomes, appended = ingest.handle_drift(
        spark, manifest.filter(F.col("status") == reports.BLOCKED), versions, database, 2, now
    )
    outcome = outcomes.first()
    assert (outcome["strategy"], outcome["status"], outcome["route"]) == ("AUTO_APPLY_DDL", "fix_applied", "rerun")
    assert catalog.has_columns(spark, f"{database}.immunizations", ["blood_type"])
    assert spark.table(f"{database}.immunizations").first()["blood_type"] is None
    newer = contracts.Contract.from_rows(versions.unionByName(appended), CONTRACT)
    assert newer.table("immunizations").types()["blood_type"] == "string"
    assert newer.table("patients").types() == CONTRACT.table("patients").types()
    _, _, again = run(spark, folder, base, database, ["immunizations"], contract=newer)
    assert again["immunizations"]["status"] == "OK"
    assert spark.table(f"{database}.immunizations").first()["blood_type"] == "A"


def test_subtractive_remediation_keeps_the_column(spark, tmp_path, database):
    folder, base = f"{tmp_path}/raw", f"{tmp_path}/tables"
    write_csv(folder, "immunizations", HEADS["immunizations"], ["2020-01-01,p,e,1,x"])
    run(spark, folder, base, database, ["immunizations"])
    write_csv(folder, "immunizations", "DATE,PATIENT,ENCOUNTER,CODE", ["2021-01-01,p,e,1"])
    manifest, _, _ = run(spark, folder, base, database, ["immunizations"])
    blocked = manifest.filter(F.col("status") == reports.BLOCKED)
    versions = CONTRACT.rows(spark)
    outcomes, appended = ingest.handle_drift(spark, blocked, versions, database, 2, dt.datetime(2024, 2, 1))
    outcome = outcomes.first()
    assert (outcome["status"], outcome["action"], outcome["route"]) == (
        "advisory", "merge_schema_fallback", "write_keeping_schema",
    )
    flagged = appended.collect()
    assert [(r["column"], r["source_status"], r["version"]) for r in flagged] == [
        ("description", "missing_from_upstream", 2)
    ]
    ingest.write_ready(spark, manifest, CONTRACT, base, database, write_blocked=True, keep_schema=True)
    row = spark.table(f"{database}.immunizations").first()
    assert row["description"] is None and row["date"] == dt.date(2021, 1, 1)


def test_changed_input_is_refused(spark, tmp_path, database):
    folder, base = f"{tmp_path}/raw", f"{tmp_path}/tables"
    write_csv(folder, "immunizations", HEADS["immunizations"], ["2020-01-01,p,e,1,x"])
    manifest = ingest.preflight(spark, folder, CONTRACT, ["immunizations"]).first()
    write_csv(folder, "immunizations", HEADS["immunizations"], ["2020-01-01,p,e,1,x", "2020-01-02,p,e,1,x"])
    done = ingest.write_table(spark, manifest, CONTRACT, base, database)
    assert done[3] == "FAILED" and "changed" in done[-1]


def test_replace_keeps_old_rows_on_failure(spark, tmp_path, database):
    table = f"{database}.t"
    catalog.replace_table(spark.range(3), table, f"{tmp_path}/tables")
    broken = spark.range(5).select(F.raise_error(F.lit("boom")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        catalog.replace_table(broken, table, f"{tmp_path}/tables")
    assert spark.table(table).count() == 3
    catalog.replace_table(spark.range(7), table, f"{tmp_path}/tables")
    assert spark.table(table).count() == 7
    catalog.replace_table(spark.range(2).withColumn("x", F.lit("y")), table, f"{tmp_path}/tables")
    assert spark.table(table).columns == ["id", "x"]


def test_add_columns_without_table(spark, database):
    got = catalog.add_columns(spark, f"{database}.none", f"ALTER TABLE {database}.none ADD COLUMNS (a STRING)")
    assert got == {"executed": True, "reason": "table does not exist yet"}
    assert catalog.add_columns(spark, f"{database}.none", " ")["executed"] is False


def test_discovery(spark, tmp_path):
    folder = f"{tmp_path}/raw"
    write_csv(folder, "Mixed_Case", "a", ["1"])
    spark.range(3).write.option("header", True).csv(f"{folder}/parts.csv")
    write_csv(folder, "note", "a", ["1"])
    os.rename(f"{folder}/note.csv", f"{folder}/note.txt")
    found = raw.discover(spark, folder)
    assert {r["table"] for r in found.collect()} == {"mixed_case", "parts"}
    assert raw.parse_table_filter(" All ", ["x", "y"]) == ["x", "y"]
    assert raw.parse_table_filter(" A, ,b ", []) == ["a", "b"]


def test_file_arrival(spark, tmp_path):
    folder, target, log, mark = (f"{tmp_path}/{x}" for x in ("raw", "out", "log", "mark"))

    def take_in():
        start_arrivals(spark, folder, CONTRACT, target, log, mark).awaitTermination()
        return {(r["table"], r["status"], r["row_count"]) for r in spark.read.parquet(log).collect()}

    write_csv(folder, "immunizations", HEADS["immunizations"], ["2020-01-01,p,e,1,x", "bad,p,e,1,x"])
    write_csv(folder, "strange", "a", ["1"])
    first = {("immunizations", "OK", 2), ("strange", "NO_CONTRACT", 0)}
    assert take_in() == first
    assert take_in() == first  # nothing new
    write_csv(folder, "allergies", HEADS["allergies"] + ",extra", ["2020-01-01,,p,e,1,x,y"])
    assert take_in() == first | {("allergies", "BLOCKED", 0)}
    days = {r["date"] for r in spark.read.parquet(f"{target}/immunizations").collect()}
    assert days == {dt.date(2020, 1, 1), None}


# ---------------------------------------------------------------- governed queries


@pytest.fixture
def people(spark):
    rows = [(f"p{i}", f"first {i}", "Boston, MA, US", "F" if i % 2 else "M") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, first string, birthplace string, gender string")
    mask.tagged(df, "patients").createOrReplaceTempView("people_view")
    return df


@pytest.mark.parametrize(
    "statement",
    ["DROP TABLE people_view", "SELECT 1; SELECT 2", "SHOW TABLES", "select * from people_view; truncate table x"],
)
def test_blocked(spark, people, statement):
    with pytest.raises(governed.Blocked):
        governed.governed_sql(spark, statement, CONTRACT, "analyst", fm.secret(spark, "k"))


def test_governed_sql(spark, people, tmp_path):
    log = f"{tmp_path}/queries"
    key = fm.secret(spark, "k")
    result = governed.governed_sql(
        spark, "```sql\nSELECT id, first, birthplace, gender FROM people_view\n```", CONTRACT, "doctor", key,
        audit_path=log, run_id="r1",
    )
    rows = result.rows.collect()
    assert len(rows) == 50 and result.truncated and not result.targeted
    assert {r["first"] for r in rows} == {"***REDACTED***"}
    assert {r["birthplace"] for r in rows} == {"Boston, MA, US"}
    few = governed.governed_sql(
        spark, "SELECT id, first, birthplace, gender FROM people_view WHERE id = 'p1'", CONTRACT, "doctor", key,
        audit_path=log, run_id="r2",
    )
    assert few.targeted and few.rows.first()["first"] == "first 1"
    none = governed.govern(people.filter("id = 'nobody'"), CONTRACT, "analyst", key, audit_path=log, run_id="r3")
    assert not none.credible and none.note == "empty result"
    entries = {r["run_id"]: r for r in spark.read.parquet(log).collect()}
    assert entries["r1"]["truncated"] and entries["r2"]["targeted"] and entries["r3"]["rows"] == 0


@pytest.mark.parametrize(
    "shown",
    ["first AS gender", "x.hello AS gender FROM (SELECT first AS hello FROM people_view) x", "first AS `any name`"],
)
def test_alias_is_masked(spark, people, shown):
    statement = f"SELECT {shown}" + ("" if "FROM" in shown else " FROM people_view")
    result = governed.governed_sql(spark, statement, CONTRACT, "analyst", fm.secret(spark, "k"))
    assert {r[0] for r in result.rows.collect()} == {"***REDACTED***"}


@pytest.mark.parametrize(
    "statement",
    ["SELECT upper(first) AS gender FROM people_view", "SELECT max(first) AS gender FROM people_view",
     "SELECT (SELECT max(first) FROM people_view) AS gender", "SELECT coalesce(gender, first) AS gender FROM people_view"],
)
def test_computed_columns_need_a_voucher(spark, people, statement):
    key = fm.secret(spark, "k")
    with pytest.raises(mask.UnmappedColumns):
        governed.governed_sql(spark, statement, CONTRACT, "analyst", key)


def test_set_operators_are_refused(spark, people):
    statement = "SELECT gender FROM people_view UNION ALL SELECT first FROM people_view"
    with pytest.raises(governed.Blocked, match="set operators"):
        governed.governed_sql(spark, statement, CONTRACT, "analyst", fm.secret(spark, "k"))


def test_count_with_many_rows_is_doubted(spark, people):
    result = governed.govern(
        people.groupBy("gender").count(), CONTRACT, "analyst", fm.secret(spark, "k"), is_count=True,
        derived=("count",),
    )
    assert not result.credible and "several" in result.note


def test_error_kinds(spark):
    from pyspark.errors import PySparkException

    for statement, kind in [("SELECT nope FROM people_view_x", "schema"), ("SELEC 1", "syntax"), ("SELECT 1/0", "logic")]:
        with pytest.raises(PySparkException) as failure:
            spark.sql(statement).collect()
        assert governed.error_kind(failure.value) == kind


def test_chartable(spark):
    assert governed.is_graphable(spark.range(1).withColumn("x", F.lit("a")))
    assert not governed.is_graphable(spark.range(1))
    pair = spark.range(1).withColumn("n", F.lit(1))
    assert governed.is_graphable(pair) and not governed.is_graphable(pair, needs_category=True)
    assert not governed.is_graphable(spark.createDataFrame([("a", "b")], "x string, y string"))


def test_fetch_is_bounded(spark):
    assert governed.fetch(spark.range(30_000), 20_000).num_rows == 10_000
    assert governed.fetch(spark.range(300)).num_rows == 50
