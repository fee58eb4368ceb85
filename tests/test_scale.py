"""Hot keys against brute force, and the shape of physical plans."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from lakewarden.functions import filters
from lakewarden.operators import aggregates as agg
from lakewarden.operators import joins, skew
from lakewarden.plans import templates
from lakewarden.plans.intent import Intent, IntentFilter, run_intent
from lakewarden.sources import audit
from workloads import clinical
from workloads.registry import load


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 facts, a third of them on one entity; some without an entity."""
    rows = [
        (None if i % 50 == 0 else "hot" if i % 3 == 0 else f"e{i % 400}", i % 7, f"value {i % 11}")
        for i in range(3000)
    ]
    facts = spark.createDataFrame(rows, "entity string, part int, text string")
    entities = spark.createDataFrame(
        [("hot", 1)] + [(f"e{i}", i) for i in range(0, 400, 2)], "id string, attribute int"
    )
    return rows, facts, entities


def test_salted_join(skewed):
    rows, facts, entities = skewed
    got = skew.salted_join(facts, entities, "entity", "id", salts=8, shares=16)
    known = {r["id"]: r["attribute"] for r in entities.collect()}
    want = Counter((e, p, t, known[e]) for e, p, t in rows if e in known)
    assert Counter((r["entity"], r["part"], r["text"], r["attribute"]) for r in got.collect()) == want
    assert [r[0] for r in skew.hot_keys(facts.filter("entity is not null"), "entity", 16).collect()] == ["hot"]


def test_salted_join_without_hot_keys(spark):
    left = spark.range(100).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = spark.range(50).select(F.col("id").alias("r"))
    assert skew.salted_join(left, right, "k", "r", shares=10).count() == 100


def test_salted_path(skewed):
    rows, facts, entities = skewed
    frames = {"patients": entities, "conditions": facts.withColumnRenamed("entity", "patient")}
    got = joins.join_path(
        "patient_conditions", frames, {"patients": ["id"], "conditions": ["text"]}, salted=True
    )
    known = {r["id"] for r in entities.collect()}
    assert Counter((r["id"], r["text"]) for r in got.collect()) == Counter(
        (e, t) for e, _, t in rows if e in known
    )


def test_cohort_of_hot_entity(skewed):
    rows, facts, _ = skewed
    got = joins.cohort_values(facts.filter("part = 3"), "entity", facts, "entity", "text")
    members = {e for e, p, _ in rows if p == 3 and e}
    assert {r["text"] for r in got.collect()} == {t for e, _, t in rows if e in members}


def test_sampled_values(skewed):
    rows, facts, _ = skewed
    got = agg.sampled_values(facts, ["entity", "text"], 3)
    by_column = {}
    for r in got.collect():
        by_column.setdefault(r["column"], []).append(r["value"])
    assert sorted(by_column["entity"]) == sorted({e for e, _, _ in rows if e})[:3]
    assert sorted(by_column["text"]) == sorted({t for _, _, t in rows})[:3]
    assert plan_of(got).count("WindowGroupLimit") >= 2  # cut before and after the shuffle


def test_latest_of_hot_table(spark):
    rows = [("hot" if i % 3 else f"t{i}", i, f"p{i}") for i in range(2000)]
    log = spark.createDataFrame(rows, "table string, at int, payload string")
    got = {r["table"]: r["payload"] for r in audit.latest_per(log, ["table"], ["at"]).collect()}
    want = {}
    for t, _, p in rows:
        want[t] = p
    assert got == want
    first = {r["table"]: r["at"] for r in audit.first_per(log, ["table"], ["at"]).collect()}
    assert first["hot"] == 1


def test_intent_against_brute_force(skewed):
    rows, facts, entities = skewed
    frames = {"patients": entities, "conditions": facts.withColumnRenamed("entity", "patient")}
    intent = Intent(
        "aggregate", ("conditions", "patients"),
        (IntentFilter("text", "LIKE", "%1%"), IntentFilter("patients.attribute", "<", 100)),
        group_by=("text",),
    )
    known = {r["id"] for r in entities.collect() if r["attribute"] < 100}
    want = Counter(t for e, _, t in rows if e in known and "1" in t)
    assert {r["text"]: r["cnt"] for r in run_intent(intent, frames).collect()} == dict(want)


def test_intent_refusals(skewed):
    _, facts, entities = skewed
    frames = {"patients": entities, "conditions": facts, "medications": facts}
    with pytest.raises(ValueError, match="no data query"):
        run_intent(Intent("other", ("patients",)), frames)
    with pytest.raises(ValueError, match="unknown target"):
        run_intent(Intent("count", ("nowhere",)), frames)
    with pytest.raises(ValueError, match="restrict"):
        run_intent(Intent("select", ("conditions", "medications"), columns=("medications.text",)), frames)
    with pytest.raises(ValueError, match="no join key"):
        joins.resolve_path(["patients", "planets"])


def test_older_than_is_the_day_count(spark):
    import datetime as dt

    as_of = dt.date(2001, 8, 1)
    days = spark.range(21800, 22000).select(
        F.expr("date_sub(date'2001-08-01', cast(id as int))").alias("birth")
    )
    literal = days.filter(F.datediff(F.lit(as_of), "birth") / 365 > 60).count()
    assert days.filter(filters.older_than(F.col("birth"), 60, as_of)).count() == literal


# ---------------------------------------------------------------- plans


def test_filters_and_columns_reach_the_scan(spark, small):
    orders = load(spark, small, "orders")
    plan = plan_of(
        orders.filter(filters.in_year(F.col("o_orderdate"), 1997)).select("o_orderkey", "o_totalprice")
    )
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema:")[1].splitlines()[0]


def test_top_k_is_bounded(spark, small):
    plan = plan_of(templates.most_frequent(clinical.encounters(spark, small)))
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_profile_is_one_scan(spark, small):
    from lakewarden.operators.quality import null_profile

    assert plan_of(null_profile(load(spark, small, "orders"))).count("Scan parquet") == 2  # tree and detail


def test_join_cuts_columns_before_the_shuffle(spark, small):
    frames = clinical.frames(spark, small, "patients", "encounters")
    plan = plan_of(
        joins.join_path("patient_encounters", frames, {"patients": ["race"], "encounters": ["code"]})
    )
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert all("c_name" not in s and "o_totalprice" not in s for s in schemas)


def test_partial_aggregation_before_shuffle(spark, small):
    plan = plan_of(audit.latest_per(load(spark, small, "events"), ["user_id"], ["ts", "event_id"]))
    assert "partial_max_by" in plan
