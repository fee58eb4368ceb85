"""Filters, joins, aggregates, limits, question templates and intents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakewarden.functions import filters
from lakewarden.operators import aggregates as agg
from lakewarden.operators import joins
from lakewarden.operators.skew import salted_join
from lakewarden.plans import templates
from lakewarden.plans.intent import Intent, IntentFilter, StarKeys, run_intent
from workloads import clinical
from workloads.registry import dates_as_text, load, query

AS_OF = dt.date(2001, 8, 1)

# ---------------------------------------------------------------- filters


@query(
    "keyword_filter",
    "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%'",
)
def keyword_filter(spark, sf):
    part = load(spark, sf, "part")
    return part.filter(filters.has_keyword(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query(
    "equality_filter",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def equality_filter(spark, sf):
    customer = load(spark, sf, "customer")
    keep = filters.intent_predicate(F.col("c_mktsegment"), "=", "BUILDING")
    return customer.filter(keep).select("c_custkey", "c_name")


@query(
    "open_interval",
    clinical.sql(
        "SELECT patient, encounter, code, description FROM conditions WHERE stop IS NULL", "conditions"
    ),
)
def open_interval(spark, sf):
    conditions = clinical.conditions(spark, sf)
    return conditions.filter(filters.still_open(F.col("stop"))).select(
        "patient", "encounter", "code", "description"
    )


@query("year_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997")
def year_filter(spark, sf):
    orders = load(spark, sf, "orders")
    return orders.filter(filters.in_year(F.col("o_orderdate"), 1997)).select(
        "o_orderkey", "o_totalprice"
    )


@query(
    "prev_month_filter",
    "SELECT o_orderkey, o_custkey FROM orders WHERE date_trunc('month', o_orderdate) "
    "= date_trunc('month', DATE '2001-08-01' - INTERVAL 1 MONTH)",
)
def prev_month_filter(spark, sf):
    orders = load(spark, sf, "orders")
    return orders.filter(filters.in_previous_month(F.col("o_orderdate"), AS_OF)).select(
        "o_orderkey", "o_custkey"
    )


@query(
    "age_filter",
    clinical.sql(
        "SELECT id, gender FROM patients WHERE date_diff('day', birthdate, DATE '2001-08-01') / 365.0 > 60",
        "patients",
    ),
)
def age_filter(spark, sf):
    p = clinical.patients(spark, sf)
    return p.filter(filters.older_than(F.col("birthdate"), 60, AS_OF)).select("id", "gender")


INTENT_CASES = [
    ("eq", "o_orderstatus", "=", "F"),
    ("ne", "o_orderstatus", "!=", "F"),
    ("lt", "o_totalprice", "<", 1000.0),
    ("le", "o_custkey", "<=", 10),
    ("gt", "o_totalprice", ">", 400000.0),
    ("ge", "o_custkey", ">=", 100),
    ("like", "o_orderpriority", "LIKE", "%HIGH%"),
    ("in", "o_orderpriority", "IN", "1-URGENT, 2-HIGH"),
    ("eq_list", "o_orderstatus", "=", ["F", "P"]),
]


@query(
    "intent_filter_ops",
    """SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS eq,
      sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END)::BIGINT AS ne,
      sum(CASE WHEN o_totalprice < 1000.0 THEN 1 ELSE 0 END)::BIGINT AS lt,
      sum(CASE WHEN o_custkey <= 10 THEN 1 ELSE 0 END)::BIGINT AS le,
      sum(CASE WHEN o_totalprice > 400000.0 THEN 1 ELSE 0 END)::BIGINT AS gt,
      sum(CASE WHEN o_custkey >= 100 THEN 1 ELSE 0 END)::BIGINT AS ge,
      sum(CASE WHEN lower(o_orderpriority) LIKE '%high%' THEN 1 ELSE 0 END)::BIGINT AS "like",
      sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS "in",
      sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END)::BIGINT AS eq_list
      FROM orders""",
)
def intent_filter_ops(spark, sf):
    orders = load(spark, sf, "orders")
    return orders.agg(
        *[
            F.count_if(filters.intent_predicate(F.col(c), op, v)).alias(name)
            for name, c, op, v in INTENT_CASES
        ]
    )


# ---------------------------------------------------------------- joins

# path -> columns shown per table
PATH_COLUMNS = {
    "patient_conditions": {"patients": ["id", "gender"], "conditions": ["description"]},
    "patient_encounters": {"patients": ["id", "race"], "encounters": ["date", "code"]},
    "encounter_conditions": {"encounters": ["id", "date", "description"], "conditions": ["description"]},
    "patient_medications_direct": {"patients": ["id", "gender"], "medications": ["description"]},
    "patient_medications_via_encounter": {
        "patients": ["id"], "encounters": ["date", "description"], "medications": ["description"],
    },
    "patient_observations": {"patients": ["id", "gender"], "observations": ["value", "units"]},
    "patient_procedures": {"patients": ["id"], "procedures": ["date", "description"]},
    "patient_allergies": {"patients": ["id", "race"], "allergies": ["description"]},
    "patient_immunizations": {"patients": ["id"], "immunizations": ["date", "description"]},
    "patient_careplans": {"patients": ["id"], "careplans": ["start", "description"]},
    "conditions_with_encounter": {
        "patients": ["id"], "encounters": ["date"], "conditions": ["description", "stop"],
    },
}


def _path_sql(path: str) -> str:
    steps, wanted = joins.JOIN_PATHS[path], PATH_COLUMNS[path]
    names = [c for cs in wanted.values() for c in cs]
    shown = [
        f'CAST({t}."{c}" AS VARCHAR) AS "{t + "_" + c if names.count(c) > 1 else c}"'
        for t, cs in wanted.items()
        for c in cs
    ]
    chain = steps[0].left + "".join(
        f" JOIN {s.right} ON {s.left}.{s.left_key} = {s.right}.{s.right_key}" for s in steps
    )
    tables = dict.fromkeys([steps[0].left, *[s.right for s in steps]])
    return clinical.sql(f"SELECT {', '.join(shown)} FROM {chain}", *tables)


def _register_path(path: str) -> None:
    tables = dict.fromkeys([joins.JOIN_PATHS[path][0].left, *[s.right for s in joins.JOIN_PATHS[path]]])

    @query(f"join_{path}", _path_sql(path))
    def run(spark, sf):
        return dates_as_text(
            joins.join_path(path, clinical.frames(spark, sf, *tables), PATH_COLUMNS[path])
        )


for _name in joins.JOIN_PATHS:
    _register_path(_name)


@query(
    "join_entity_fact",
    "SELECT c_mktsegment, o_orderstatus, count(*) AS cnt FROM customer JOIN orders "
    "ON c_custkey = o_custkey GROUP BY 1, 2",
)
def join_entity_fact(spark, sf):
    # counted per entity before the join, so a busy customer crosses it as a few rows
    per_customer = (
        load(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("_n"))
    )
    customer = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "o_orderstatus")
        .agg(F.sum("_n").alias("cnt"))
    )


@query(
    "join_chain3",
    """SELECT c_mktsegment, o_orderpriority, count(*) AS n_lines,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
      FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
      GROUP BY 1, 2""",
)
def join_chain3(spark, sf):
    # lines are summed per order first, in whole cents: the fact enters the chain with one row per
    # order, and the sums neither round nor depend on their order
    per_order = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("_cents"),
    )
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.sum("_n").alias("n_lines"), (F.sum("_cents") / 100).alias("revenue"))
    )


@query(
    "salted_join",
    "SELECT e.user_id, e.event_id, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey",
)
def hot_key_join(spark, sf):
    events = load(spark, sf, "events").select("user_id", "event_id")
    customer = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return salted_join(events, customer, "user_id", "c_custkey").select(
        "user_id", "event_id", "c_mktsegment"
    )


@query(
    "cohort_semi_join",
    clinical.sql(
        """SELECT DISTINCT m.description AS medication FROM conditions c JOIN medications m
        ON c.patient = m.patient WHERE lower(c.description) LIKE '%finding r 6%'""",
        "conditions", "medications",
    ),
)
def cohort_semi_join(spark, sf):
    conditions = clinical.conditions(spark, sf)
    cohort = conditions.filter(filters.has_keyword(F.col("description"), "finding r 6"))
    return joins.cohort_values(
        cohort, "patient", clinical.medications(spark, sf), "patient", "description", "medication"
    )


@query(
    "join_path_resolver",
    clinical.sql(
        """SELECT p.id, e.description AS encounters_description, a.description AS allergies_description
        FROM patients p JOIN encounters e ON p.id = e.patient JOIN
        (SELECT DISTINCT patient, description FROM allergies) a ON p.id = a.patient""",
        "patients", "encounters", "allergies",
    ),
)
def join_path_resolver(spark, sf):
    frames = clinical.frames(spark, sf, "patients", "encounters", "allergies")
    steps = joins.resolve_path(["patients", "allergies", "encounters"])
    return joins.join_path(
        steps, frames,
        {"patients": ["id"], "encounters": ["description"], "allergies": ["description"]},
    )


@query(
    "unique_projection",
    """SELECT c.c_custkey AS customer_key, o.o_custkey AS orders_key, c.c_name AS "name",
      o.o_orderkey AS number FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey""",
)
def unique_projection(spark, sf):
    customer = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name")
    )
    orders = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("number")
    )
    cut = joins.project_unique(
        {"customer": customer, "orders": orders},
        {"customer": ["key", "name"], "orders": ["key", "number"]},
    )
    return cut["customer"].join(cut["orders"], F.col("customer_key") == F.col("orders_key"))


# ---------------------------------------------------------------- aggregates


@query("count_rows", "SELECT count(*) AS row_count FROM lineitem")
def count_rows(spark, sf):
    return agg.row_count(load(spark, sf, "lineitem"))


@query("count_distinct_entities", "SELECT count(DISTINCT user_id) AS entities FROM events")
def count_distinct_entities(spark, sf):
    return agg.distinct_entities(load(spark, sf, "events"), "user_id")


@query("group_count", "SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type")
def group_count(spark, sf):
    return agg.group_counts(load(spark, sf, "events"), "event_type")


@query(
    "avg_per_entity",
    "SELECT round(avg(n), 6) AS avg_orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)",
)
def avg_per_entity(spark, sf):
    mean = agg.mean_rows_per_entity(load(spark, sf, "orders"), "o_custkey", "avg_orders")
    return mean.select(F.round("avg_orders", 6).alias("avg_orders"))


@query(
    "avg_cast_by_unit",
    clinical.sql(
        "SELECT units, round(avg(TRY_CAST(value AS DOUBLE)), 6) AS avg_value FROM observations GROUP BY units",
        "observations",
    ),
)
def avg_cast_by_unit(spark, sf):
    mean = agg.mean_by_unit(clinical.observations(spark, sf), "value", "units", "avg_value")
    return mean.select("units", F.round("avg_value", 6).alias("avg_value"))


@query(
    "having_filter",
    "SELECT l_orderkey, count(*) AS cnt FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6",
)
def having_filter(spark, sf):
    return agg.busy_groups(load(spark, sf, "lineitem"), "l_orderkey", 6)


@query(
    "distinct_rows",
    "SELECT DISTINCT p_brand, p_type FROM part",
)
def distinct_rows(spark, sf):
    return load(spark, sf, "part").select("p_brand", "p_type").distinct()


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "table_inventory",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
)
def table_inventory(spark, sf):
    return agg.table_inventory({t: load(spark, sf, t) for t in TABLES})


# ---------------------------------------------------------------- sorts and limits


@query(
    "topk_groups",
    "SELECT p_name, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey "
    "GROUP BY p_name ORDER BY cnt DESC, p_name LIMIT 10",
)
def topk_groups(spark, sf):
    # line counts per part, then per name: the join sees one row per part
    per_part = agg.group_counts(load(spark, sf, "lineitem"), "l_partkey", alias="_n")
    part = load(spark, sf, "part").select("p_partkey", "p_name")
    return (
        per_part.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_name")
        .agg(F.sum("_n").alias("cnt"))
        .orderBy(F.desc("cnt"), "p_name")
        .limit(10)
    )


@query(
    "full_order",
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey",
)
def full_order(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(
        F.desc("c_acctbal"), "c_custkey"
    )


@query(
    "default_cap",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def default_cap(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return agg.capped(orders.orderBy(F.desc("o_totalprice"), "o_orderkey"))


@query(
    "hard_cap",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10000",
)
def hard_cap(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return agg.capped(orders.orderBy(F.desc("o_totalprice"), "o_orderkey"), wanted=1_000_000)


@query(
    "preview",
    "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 5",
)
def preview(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "event_type")
    return agg.first_rows(events, 5, F.col("event_id"))


@query(
    "size_probe",
    "SELECT c_custkey, least(count(*), 11) AS probed, count(*) <= 10 AS targeted "
    "FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
)
def size_probe(spark, sf):
    counts = agg.group_counts(load(spark, sf, "orders"), "o_custkey", alias="n")
    customer = load(spark, sf, "customer").select("c_custkey")
    joined = counts.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "c_custkey", F.least("n", F.lit(11)).alias("probed"), (F.col("n") <= 10).alias("targeted")
    )


@query(
    "truncation_flag",
    "SELECT o_custkey, count(*) > 12 AS truncated, least(count(*), 12) AS shown FROM orders GROUP BY o_custkey",
)
def truncation_flag(spark, sf):
    counts = agg.group_counts(load(spark, sf, "orders"), "o_custkey", alias="n")
    return counts.select(
        "o_custkey", (F.col("n") > 12).alias("truncated"), F.least("n", F.lit(12)).alias("shown")
    )


@query(
    "value_sample",
    " UNION ALL ".join(
        f"(SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM "
        f"(SELECT DISTINCT {c} FROM part) ORDER BY value LIMIT 5)"
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def value_sample(spark, sf):
    return agg.sampled_values(load(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query(
    "sampled_values_for_tables",
    " UNION ALL ".join(
        f"(SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM "
        f"(SELECT DISTINCT {c} FROM {t}) ORDER BY value LIMIT 5)"
        for t, c in (
            ("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"),
        )
    ),
)
def sampled_values_for_tables(spark, sf):
    sampled = None
    for t, columns in {
        "customer": ["c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"],
    }.items():
        part = agg.sampled_values(load(spark, sf, t), columns).select(
            F.lit(t).alias("table"), "column", "value"
        )
        sampled = part if sampled is None else sampled.unionByName(part)
    return sampled


# ---------------------------------------------------------------- question templates


@query(
    "template_q1",
    clinical.sql(
        """, hit AS (SELECT patient FROM conditions WHERE contains(lower(description), 'finding a 3') GROUP BY patient)
        SELECT count(patient) AS entities FROM hit""",
        "conditions",
    ),
)
def template_q1(spark, sf):
    return templates.entities_with_keyword(clinical.conditions(spark, sf), "finding a 3")


@query(
    "template_q2",
    clinical.sql(
        """SELECT count(*) AS rows_last_month FROM encounters WHERE "date" >= DATE '2001-07-01' AND "date" < DATE '2001-08-01'""",
        "encounters",
    ),
)
def template_q2(spark, sf):
    return templates.rows_last_month(clinical.encounters(spark, sf), AS_OF)


@query(
    "template_q3",
    clinical.sql(
        """, tally AS (SELECT description, count(*) AS n_rows FROM medications GROUP BY ALL)
        SELECT * FROM tally QUALIFY row_number() OVER (ORDER BY n_rows DESC, description) <= 5""",
        "medications",
    ),
)
def template_q3(spark, sf):
    return templates.most_frequent(clinical.medications(spark, sf))


@query(
    "template_q4",
    clinical.sql(
        """, cohort AS (SELECT patient FROM allergies WHERE contains(lower(description), 'purchase'))
        SELECT id, gender, race FROM patients WHERE id IN (FROM cohort) GROUP BY ALL""",
        "patients", "allergies",
    ),
)
def template_q4(spark, sf):
    t = clinical.frames(spark, sf, "patients", "allergies")
    return templates.entities_having(t["patients"], t["allergies"], "purchase", ["id", "gender", "race"])


@query(
    "template_q5",
    clinical.sql(
        """, per AS (SELECT patient, count(*) AS n FROM encounters GROUP BY patient)
        SELECT round(sum(n) / count(*), 6) AS rows_per_entity FROM per""",
        "encounters",
    ),
)
def template_q5(spark, sf):
    mean = templates.mean_facts_per_entity(clinical.encounters(spark, sf))
    return mean.select(F.round("rows_per_entity", 6).alias("rows_per_entity"))


def _q6_sql(k: int) -> str:
    return clinical.sql(
        f""", older AS (SELECT id FROM patients WHERE CAST(birthdate AS DATE) < DATE '2001-08-01' - 60 * 365),
          tally AS (SELECT description, count(*) AS n_rows FROM conditions WHERE patient IN (FROM older) GROUP BY ALL)
        SELECT * FROM tally QUALIFY row_number() OVER (ORDER BY n_rows DESC, description) <= {k}""",
        "patients", "conditions",
    )


@query("template_q6", _q6_sql(10))
def template_q6(spark, sf):
    t = clinical.frames(spark, sf, "patients", "conditions")
    return templates.frequent_among_older(t["patients"], t["conditions"], 60, AS_OF)


@query(
    "template_q7",
    clinical.sql(
        """, numbers AS (SELECT units, TRY_CAST(value AS DOUBLE) AS x FROM observations WHERE contains(lower(description), 'click'))
        SELECT units, round(avg(x), 6) AS avg_value FROM numbers GROUP BY ALL""",
        "observations",
    ),
)
def template_q7(spark, sf):
    mean = templates.mean_value_by_unit(clinical.observations(spark, sf), "click")
    return mean.select(F.round("avg_value", 6).alias("avg_value"), "units")


@query(
    "template_q8",
    clinical.sql(
        """SELECT count(*) AS row_count FROM immunizations WHERE "date" >= DATE '2024-01-01' AND "date" < DATE '2025-01-01'""",
        "immunizations",
    ),
)
def template_q8(spark, sf):
    return templates.rows_in_year(clinical.immunizations(spark, sf), 2024)


@query(
    "template_q9",
    clinical.sql(
        """, open_rows AS (SELECT patient, count(*) FILTER (stop IS NULL) AS n_open FROM conditions GROUP BY patient)
        FROM open_rows WHERE n_open > 3""",
        "conditions",
    ),
)
def template_q9(spark, sf):
    return templates.entities_with_open_facts(clinical.conditions(spark, sf))


@query(
    "template_q10",
    clinical.sql(
        """, cohort AS (SELECT patient FROM conditions WHERE contains(lower(description), 'finding n 7'))
        SELECT description AS value FROM medications WHERE patient IN (FROM cohort) GROUP BY ALL""",
        "conditions", "medications",
    ),
)
def template_q10(spark, sf):
    t = clinical.frames(spark, sf, "conditions", "medications")
    return templates.values_for_cohort(t["conditions"], "finding n 7", t["medications"])


@query(
    "segment_keyword_count",
    clinical.sql(
        """SELECT count(DISTINCT p.id) AS patient_count FROM patients p JOIN conditions c ON p.id = c.patient
        WHERE p.gender = 'F' AND LOWER(c.description) LIKE '%finding a%'
        AND year(c."start") = 1998""",
        "patients", "conditions",
    ),
)
def segment_keyword_count(spark, sf):
    t = clinical.frames(spark, sf, "patients", "conditions")
    return templates.segment_with_keyword(
        t["patients"], F.col("gender") == "F", t["conditions"], "finding a",
        within=filters.in_year(F.col("start"), 1998),
    )


@query("total_entities", clinical.sql("SELECT count(*) AS total FROM patients", "patients"))
def total_entities(spark, sf):
    return templates.total_rows(clinical.patients(spark, sf))


@query("top5_conditions_over_60", _q6_sql(5))
def top5_conditions_over_60(spark, sf):
    t = clinical.frames(spark, sf, "patients", "conditions")
    return templates.frequent_among_older(t["patients"], t["conditions"], 60, AS_OF, k=5)


# ---------------------------------------------------------------- intents


@query(
    "run_intent_count",
    clinical.sql(
        """SELECT count(*) AS cnt FROM encounters e WHERE e.code = 'F' AND EXISTS
        (SELECT 1 FROM patients p WHERE p.id = e.patient AND p.gender = 'F')""",
        "patients", "encounters",
    ),
)
def run_intent_count(spark, sf):
    intent = Intent(
        "count", ("encounters", "patients"),
        (IntentFilter("code", "=", "F"), IntentFilter("patients.gender", "=", "F")),
    )
    return run_intent(intent, clinical.frames(spark, sf, "encounters", "patients"))


@query(
    "run_intent_group",
    clinical.sql(
        """SELECT p.race, e.code, count(*) AS cnt FROM encounters e JOIN patients p ON p.id = e.patient
        WHERE lower(e.description) LIKE '%high%' GROUP BY 1, 2 ORDER BY cnt DESC, race, code LIMIT 7""",
        "patients", "encounters",
    ),
)
def run_intent_group(spark, sf):
    intent = Intent(
        "aggregate", ("encounters", "patients"), (IntentFilter("description", "LIKE", "%high%"),),
        group_by=("patients.race", "code"), limit=7,
    )
    return run_intent(intent, clinical.frames(spark, sf, "encounters", "patients"))


@query(
    "run_intent_select",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000 AND o_custkey IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey IN "
    "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def run_intent_select(spark, sf):
    intent = Intent(
        "select", ("orders", "customer"),
        (
            IntentFilter("o_totalprice", ">", 450000),
            IntentFilter("customer.c_mktsegment", "=", "BUILDING"),
            IntentFilter("o_orderstatus", "=", "F"),
        ),
        columns=("o_orderkey", "o_totalprice"), limit=10_000,
    )
    frames = {"orders": load(spark, sf, "orders"), "customer": load(spark, sf, "customer")}
    keys = StarKeys("customer", "c_custkey", {"orders": "o_custkey"})
    return run_intent(intent, frames, keys)
