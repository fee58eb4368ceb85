"""The routed run, versioned tables, raw files of mixed headers, type lattices, quarantine and the arrival ledger."""

import datetime as dt
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from lakewarden.plans import ingest, routes
from lakewarden.plans.domain import clinical_contract
from lakewarden.sources import catalog, raw
from lakewarden.sources.contract import ColumnSpec, Contract, TableSpec
from lakewarden.sources.versions import Outpaced, VersionedTable
from lakewarden.streaming.arrival import WAITING, WRITTEN, ledger, start_arrivals

CONTRACT = clinical_contract()
HEAD = "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION"


def put(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def database(spark, tmp_path):
    name = f"r{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/catalog'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


# ---------------------------------------------------------------- routes


def test_every_route_is_followed_and_resumed(spark, tmp_path, database, monkeypatch):
    folder, base, audit = tmp_path / "raw", f"{tmp_path}/tables", f"{tmp_path}/audit"
    put(folder, "immunizations.csv", HEAD + ",blood_type", "2020-01-01,p,e,1,x,A")  # additive
    put(folder, "allergies.csv", "START,STOP,PATIENT,ENCOUNTER,CODE", "2020-01-15,,p1,e1,1")  # a column is missing
    put(folder, "careplans.csv", "ID,START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION,REASONCODE,REASONDESCRIPTION", "c,bad,,p,e,1,x,,")
    wanted = ["immunizations", "allergies", "careplans", "absent"]
    written = []
    real = ingest.write_table

    def counted(*args, **options):
        written.append(args[1]["table"])
        if args[1]["table"] == "careplans" and written.count("careplans") == 1:
            raise KeyboardInterrupt  # the driver dies before the last table
        return real(*args, **options)

    monkeypatch.setattr(ingest, "write_table", counted)
    options = dict(database=database, run_id="r1", now=dt.datetime(2024, 2, 1), at_once=1)
    with pytest.raises(KeyboardInterrupt):
        routes.run(spark, str(folder), CONTRACT, wanted, base, audit, **options)
    out = {r["table"]: r for r in routes.run(spark, str(folder), CONTRACT, wanted, base, audit, **options).collect()}
    assert {t: (r["route"], r["status"], r["row_count"]) for t, r in out.items()} == {
        "immunizations": ("rerun", "OK", 1), "allergies": ("write_keeping_schema", "OK", 1), "careplans": ("write", "OK", 1),
        "absent": ("skip", "SKIPPED", 0),
    }
    assert sorted(written) == ["allergies", "careplans", "careplans", "immunizations"]  # finished tables are not written again
    assert out["careplans"]["lost"] == {"start": 1, "stop": 0} and "values lost in start" in out["careplans"]["note"]
    assert spark.table(f"{database}.immunizations").first()["blood_type"] == "A"
    logs = {k: spark.read.parquet(f"{audit}/{k}") for k in ("drift", "remediation", "ingestion")}
    assert {r["table"] for r in logs["drift"].collect()} == {"immunizations", "allergies"}
    assert {r["status"] for r in logs["remediation"].collect()} == {"fix_applied", "advisory"}
    assert sorted(r["table"] for r in logs["ingestion"].collect()) == sorted(wanted)


def test_a_failing_statement_costs_its_table_only(spark, tmp_path, database, monkeypatch):
    folder, base, audit = tmp_path / "raw", f"{tmp_path}/tables", f"{tmp_path}/audit"
    put(folder, "immunizations.csv", HEAD + ",blood_type", "2020-01-01,p,e,1,x,A")
    put(folder, "allergies.csv", "START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION,extra", "2020-01-15,,p1,e1,1,Peanut,y")
    real = catalog.add_columns

    def broken(spark, table, statement):
        if table.endswith("allergies"):
            raise RuntimeError("no such luck")
        return real(spark, table, statement)

    monkeypatch.setattr(catalog, "add_columns", broken)
    out = routes.run(spark, str(folder), CONTRACT, ["allergies", "immunizations"], base, audit, database=database)
    got = {r["table"]: (r["remediation"], r["route"], r["status"]) for r in out.collect()}
    assert got == {"allergies": ("error", "skip", "SKIPPED"), "immunizations": ("fix_applied", "rerun", "OK")}


def test_reviews_are_applied(spark, database):
    spark.sql(f"CREATE TABLE {database}.allergies (start DATE, patient STRING) USING parquet")
    columns = "table string, full_table string, drift_kind string, sql_fix string, new_json string, new_columns array<string>, missing_columns array<string>"
    json_ = '{"extra": {"type": "string", "phi": false}}'
    full = f"{database}.allergies"
    rows = [
        ("allergies", full, "additive_only", f"ALTER TABLE {full} ADD COLUMNS (extra STRING)", json_, ["extra"], []),
        ("careplans", f"{database}.careplans", "additive_only", f"ALTER TABLE {database}.careplans ADD COLUMNS (extra STRING)", json_, ["extra"], []),
        ("patients", f"{database}.patients", "additive_only", f"DROP TABLE {database}.patients", json_, ["extra"], []),
    ]
    said = [("allergies", "approve", None, None), ("careplans", "decline", None, None), ("patients", "approve", None, None)]
    pending = spark.createDataFrame(rows, columns)
    decisions = spark.createDataFrame(said, "table string, decision string, override_sql string, override_json string")
    outcomes, appended = routes.apply_reviews(spark, pending, decisions, CONTRACT, 2)
    got = {r["table"]: (r["review_status"], r["route"]) for r in outcomes.collect()}
    assert got == {"allergies": ("fix_applied", "rerun"), "careplans": ("fix_declined", "skip"), "patients": ("error", "skip")}
    assert catalog.has_columns(spark, full, ["extra"])
    assert [(r["table"], r["column"], r["version"]) for r in appended.collect()] == [("allergies", "extra", 2)]


# ---------------------------------------------------------------- versioned tables


def test_readers_see_whole_versions_while_the_schema_changes(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    frames = [spark.range(10 * i).withColumn(f"c{i % 3}", F.lit(i)) for i in range(1, 7)]
    table.write(frames[0])
    problems, seen, stop = [], set(), threading.Event()

    def look():
        while not stop.is_set():
            try:
                df = table.read()
                rows = df.collect()
                value = rows[0][1]
                seen.add(value)
                if df.columns != ["id", f"c{value % 3}"] or len(rows) != 10 * value:
                    problems.append((df.columns, len(rows)))
            except Exception as failure:
                problems.append(failure)

    readers = [threading.Thread(target=look) for _ in range(3)]
    for r in readers:
        r.start()
    for df in frames[1:]:
        table.write(df)
    stop.set()
    for r in readers:
        r.join()
    assert not problems and len(seen) > 1
    old = table.read(2)
    assert table.numbers() == [1, 2, 3, 4, 5, 6] and old.count() == 20
    assert len(table.remove_old(keep=1)) == 5 and table.numbers() == [6] and table.read().count() == 60


def test_of_two_writers_one_wins(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    first = table.write(spark.range(1))
    table.write(spark.range(2), after=first.number)
    with pytest.raises(Outpaced):
        table.write(spark.range(3), after=first.number)
    assert table.read().count() == 2
    assert len(table.remove_old(keep=5)) == 1  # the loser's folder


# ---------------------------------------------------------------- raw files


def test_parts_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "orders.csv"
    put(folder, "p1.csv", "id,customer", "1,10", "2,20")
    put(folder, "p2.csv", "Customer,ID", "30,3")
    put(folder, "p3.csv", "id,customer,\"note, long\"", '4,40,"a, b"')
    put(folder, "p4 x+y.csv", "id,customer", "id,customer")
    rows = raw.scan_by_name(spark, str(folder)).orderBy("id").collect()
    assert rows[0].asDict() == {"id": "1", "customer": "10", "note, long": None}
    assert [tuple(r) for r in rows] == [("1", "10", None), ("2", "20", None), ("3", "30", None), ("4", "40", "a, b"), ("id", "customer", None)]


def test_all_rows_decide_types(spark, tmp_path):
    lines = [f"{i},{i},{i}.5,2020-01-{i % 28 + 1:02d},true,{i}" for i in range(1, 400)]
    lines += ["AB-777,3000000000,oops,2020-01-01 10:00:00,maybe,1234567890123456789012", ",,,,,"]
    put(tmp_path, "t.csv", "a,b,c,d,e,f", *lines)
    df = raw.scan_inferred(spark, f"{tmp_path}/t.csv", sample=0.05)
    assert dict(df.dtypes) == {"a": "string", "b": "bigint", "c": "string", "d": "timestamp", "e": "string", "f": "string"}
    last = df.filter("a = 'AB-777'").first()
    assert (last.b, last.c, last.e, last.f) == (3000000000, "oops", "maybe", "1234567890123456789012")
    assert df.filter("a is null").count() == 1 and df.count() == 401


def test_quarantine_skips_one_header_per_file(spark, tmp_path):
    put(tmp_path / "q", "a.csv", "key,name", "1,x", "key,name", "2", "3,y,z")
    put(tmp_path / "q", "b.csv", "key,name", "4,\"two", "lines\"", "5,v")
    clean, rejected = raw.scan_quarantine(spark, f"{tmp_path}/q", ["key", "name"], multi_line=True)
    assert sorted(tuple(r) for r in clean.collect()) == [("1", "x"), ("4", "two\nlines"), ("5", "v"), ("key", "name")]
    assert sorted(r[0] for r in rejected.collect()) == ["2", "3,y,z"] and rejected.count() == 2
    assert clean.select("name").count() == 4


# ---------------------------------------------------------------- arrival


def test_refused_files_wait_until_the_contract_grows(spark, tmp_path):
    folder = tmp_path / "raw"
    target, log, mark = (f"{tmp_path}/{x}" for x in ("out", "log", "mark"))
    put(folder / "immunizations.csv", "good.csv", HEAD, "2020-01-01,p,e,1,x", "2020-01-02,p,e,1,x")
    put(folder / "immunizations.csv", "late.csv", HEAD + ",blood_type", "2020-01-03,p,e,1,x,A")
    put(folder, "strange.csv", "a,b", "1,2")

    def take_in(contract):
        start_arrivals(spark, str(folder), contract, target, log, mark).awaitTermination()
        return {r["path"].rsplit("/", 1)[1]: r["status"] for r in ledger(spark, log).collect()}

    assert take_in(CONTRACT) == {"good.csv": WRITTEN, "late.csv": WAITING, "strange.csv": WAITING}
    assert spark.read.parquet(f"{target}/immunizations").count() == 2
    status = {r["table"]: (r["status"], r["row_count"], r["waiting"]) for r in spark.read.parquet(log).collect()}
    assert status == {"immunizations": ("PARTIAL", 2, 1), "strange": ("NO_CONTRACT", 0, 1)}
    assert take_in(CONTRACT)["late.csv"] == WAITING  # nothing new, nothing lost
    spec = CONTRACT.table("immunizations")
    grown = TableSpec("immunizations", (*spec.columns, ColumnSpec("blood_type")), spec.entity_column)
    both = Contract({**CONTRACT.tables, "immunizations": grown, "strange": TableSpec("strange", (ColumnSpec("a", "int"), ColumnSpec("b")))}, CONTRACT.roles)
    for _ in range(2):  # once is enough
        assert set(take_in(both).values()) == {WRITTEN}
        rows = spark.read.option("mergeSchema", True).parquet(f"{target}/immunizations").orderBy("date").collect()
        assert [(r["date"].day, r["blood_type"]) for r in rows] == [(1, None), (2, None), (3, "A")]
        assert [r["a"] for r in spark.read.parquet(f"{target}/strange").collect()] == [1]
