"""Masking: exact values, determinism, joins, intervals, roles, and nothing secret in plans."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import plan_of
from lakewarden.functions import masking as fm
from lakewarden.operators import mask
from lakewarden.plans.domain import clinical_contract
from lakewarden.sources.contract import load_contract
from workloads.contract import CONTRACT


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_pseudonym(spark):
    key = fm.secret(spark, "k")
    assert value(spark, fm.pseudonym(F.lit("abc-1"), key)) == "e4032982-70c6-b5a9-5024-e8bf04d5fcd6"
    assert value(spark, fm.pseudonym(F.lit(None).cast("string"), key)) is None


def test_date_shift(spark):
    key = fm.secret(spark, "k")
    assert value(spark, fm.shift_days(F.lit("abc-1"), key)) == 111
    day = F.lit(dt.date(2020, 1, 31))
    assert value(spark, fm.shifted(day, T.DateType(), F.lit("abc-1"), key)) == dt.date(2020, 5, 21)
    nobody = F.lit(None).cast("string")
    assert value(spark, fm.shifted(day, T.DateType(), nobody, key)) is None


def test_shift_range_and_hashlib(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("id"))
    rows = ids.select("id", fm.shift_days(F.col("id"), fm.secret(spark, "z")).alias("d")).collect()
    for r in rows:
        digest = hashlib.sha256(f"z:dateshift:{r['id']}".encode()).hexdigest()
        assert r["d"] == int(digest[:4], 16) % 731 - 365
        assert -365 <= r["d"] <= 365


@pytest.mark.parametrize(
    "place, area",
    [("Boston Heights, MA, US", "MA"), ("Springfield, MA", "MA"), ("Boston", "GENERALIZED"), (None, None)],
)
def test_generalize(spark, place, area):
    assert value(spark, fm.generalized(F.lit(place).cast("string"))) == area


@pytest.mark.parametrize("code, kept", [("02134", "021"), ("02", None), (None, None)])
def test_truncate(spark, code, kept):
    assert value(spark, fm.first_three(F.lit(code).cast("string"))) == kept


def test_key_is_required_and_hidden(spark):
    with pytest.raises(ValueError):
        fm.secret(spark, "")
    df = spark.range(5).select(fm.pseudonym(F.col("id"), fm.secret(spark, "s3cr3t-value")).alias("p"))
    df.collect()
    assert "s3cr3t-value" not in plan_of(df)
    assert "s3cr3t-value" not in df._jdf.queryExecution().toString()


def test_targeted_threshold(spark):
    ten = spark.range(10).select(F.col("id").alias("c_custkey"))
    eleven = spark.range(11).select(F.col("id").alias("c_custkey"))
    assert mask.is_targeted(ten, CONTRACT, "doctor")
    assert not mask.is_targeted(eleven, CONTRACT, "doctor")
    assert not mask.is_targeted(ten, CONTRACT, "analyst")


@pytest.mark.parametrize("role", ["doctor", "analyst", "sysadmin", "nobody"])
def test_no_masked_class_is_left(spark, role):
    """For every role, each column of a class it may not see differs from the input or is NULL."""
    contract = clinical_contract()
    spec = contract.table("patients")
    row = {c.column: dt.date(1980, 5, 17) if c.type == "date" else f"raw, {c.column}, x" for c in spec.columns}
    schema = T.StructType(
        [T.StructField(c.column, T.DateType() if c.type == "date" else T.StringType()) for c in spec.columns]
    )
    df = spark.createDataFrame([tuple(row.values())] * 12, schema)
    out = mask.mask_result(df, contract, role, fm.secret(spark, "k")).first()
    hidden = contract.role(role).masked_phi_types
    for c in spec.columns:
        if c.phi_type in hidden:
            assert out[c.column] != row[c.column], c.column
        else:
            assert out[c.column] == row[c.column], c.column


def test_intervals_and_order_of_columns(spark):
    """The shift uses the unmasked entity even when the entity column comes first."""
    df = spark.createDataFrame(
        [("p1", dt.date(2020, 1, 1), dt.date(2020, 3, 1)), ("p2", dt.date(2020, 1, 1), None)],
        "patient string, start date, stop date",
    )
    lineage = {c: ("conditions", c) for c in df.columns}
    key = fm.secret(spark, "k")
    out = mask.mask_result(df, clinical_contract(), "analyst", key, lineage).orderBy("stop").collect()
    assert out[0]["stop"] is None
    assert out[1]["stop"] - out[1]["start"] == dt.timedelta(days=60)
    days = {p: int(hashlib.sha256(f"k:dateshift:{p}".encode()).hexdigest()[:4], 16) % 731 - 365 for p in ("p1", "p2")}
    assert out[1]["start"] == dt.date(2020, 1, 1) + dt.timedelta(days=days["p1"])
    assert out[0]["start"] == dt.date(2020, 1, 1) + dt.timedelta(days=days["p2"])


def test_date_without_entity(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),)], "start date")
    lineage = {"start": ("conditions", "start")}
    key = fm.secret(spark, "k")
    null_kept = mask.mask_result(df, clinical_contract(), "analyst", key, lineage)
    assert null_kept.dtypes == [("start", "date")] and null_kept.first()["start"] is None
    text = mask.mask_result(df, clinical_contract(), "analyst", key, lineage, literal_dates=True)
    assert text.first()["start"] == "***DATE_REDACTED***"


def test_strict_refuses_unknown_columns(spark):
    df = spark.range(1).select(F.col("id").alias("renamed"))
    with pytest.raises(mask.UnmappedColumns):
        mask.mask_result(df, CONTRACT, "analyst", fm.secret(spark, "k"), strict=True)


def test_ingest_hash_of_null(spark):
    df = spark.createDataFrame([(None, "1982-03-14", "x"), ("a", "bad", "y")], "id string, birthdate string, ssn string")
    out = mask.mask_at_ingest(df, fm.secret(spark, "salt")).collect()
    assert out[0]["id"] == hashlib.sha256(b"salt").hexdigest()
    assert out[1]["id"] == hashlib.sha256(b"salt|a").hexdigest()
    assert (out[0]["birthdate"], out[1]["birthdate"]) == (1982, None)
    assert out[0]["ssn"] is None


def test_contract_file(spark):
    import lakewarden.contracts as folder

    path = folder.__path__[0] + "/clinical.json"
    assert load_contract(spark, path) == clinical_contract()
    with pytest.raises(ValueError, match="patients"):
        clinical_contract().table("nope")
