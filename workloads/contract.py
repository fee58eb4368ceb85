"""Column contract of the given tables, used by the masking, quality and governed-query checks."""

from __future__ import annotations

from lakewarden.sources.contract import ColumnSpec, Contract, TableSpec

D, Q = "DIRECT_IDENTIFIER", "QUASI_IDENTIFIER"


def _spec(name: str, entity: str | None, *columns: ColumnSpec) -> TableSpec:
    return TableSpec(name, tuple(columns), entity)


C = ColumnSpec

CONTRACT = Contract(
    {
        t.name: t
        for t in (
            _spec(
                "customer", "c_custkey",
                C("c_custkey", "long", D, "FPE_UUID"), C("c_name", "string", D, "REDACT"),
                C("c_nationkey", "int"), C("c_acctbal", "double", Q, "ROUND_2DP"),
                C("c_mktsegment", "string", Q, "TRUNCATE_3DIG"),
            ),
            _spec(
                "orders", "o_custkey",
                C("o_orderkey", "long", D, "FPE_UUID"), C("o_custkey", "long", D, "FPE_UUID"),
                C("o_orderstatus"), C("o_totalprice", "double", Q, "ROUND_2DP"),
                C("o_orderdate", "timestamp", Q, "FPE_DATE_SHIFT"), C("o_orderpriority"),
            ),
            _spec(
                "lineitem", "l_orderkey",
                C("l_orderkey", "long", D, "FPE_UUID"), C("l_partkey", "long"),
                C("l_quantity", "double"), C("l_shipdate", "timestamp", Q, "FPE_DATE_SHIFT"),
                C("l_returnflag"), C("l_linestatus"),
            ),
            _spec(
                "supplier", "s_suppkey",
                C("s_suppkey", "long"), C("s_name", "string", D, "REDACT"), C("s_nationkey", "int"),
                C("s_acctbal", "double", Q, "UNKNOWN_STRATEGY"),
            ),
            _spec(
                "events", "user_id",
                C("event_id", "long"), C("ts", "timestamp", Q, "FPE_DATE_SHIFT"),
                C("user_id", "long", D, "FPE_UUID"), C("event_type"), C("value", "double"),
            ),
            _spec("places", None, C("place", "string", Q, "GENERALIZE"), C("rows", "long")),
        )
    }
)
