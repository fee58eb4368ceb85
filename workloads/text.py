"""Text gates, answer parsing, credibility and governed results over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewarden.functions import masking as fm
from lakewarden.functions import text as gates
from lakewarden.operators import policy
from lakewarden.plans import governed
from lakewarden.sources.contract import ColumnSpec, Contract, TableSpec
from workloads import masking as masking_queries
from workloads.contract import CONTRACT
from workloads.registry import dates_as_text, load, query

#: The contract with the nations as an open table.
OPEN = Contract({**CONTRACT.tables, "nation": TableSpec("nation", (ColumnSpec("n_nationkey", "int"), ColumnSpec("n_name")))}, CONTRACT.roles)


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _pick_sql(values, index):
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][({index})::INT % {len(values)} + 1]"


OPENINGS = [
    "Show top 20 rows about ", "please DELETE everything on ", "how many mention ", "last 3 notes on ",
    "List any 12 of ", "clear the cache of ", "get all about ", "update the text ", "any thing about ",
    "first 007 lines of ", "whatever dropped from ", "fetch stop 5 and ",
]
STATEMENTS = [
    "SELECT a FROM t -- ", "DROP TABLE t; ", "select 1 as updated_at ", "WITH x AS (SELECT 1) SELECT * FROM x ",
    "insert into t values (1) ", "SELECT replace(a, 'b') FROM t ", "GRANT SELECT ON t TO u ", "MERGE INTO t ",
    "SELECT created FROM t ", "truncate table t ",
]


def _questions(spark, sf):
    """One question per conversation turn: an opening and the whole text of the turn."""
    c = load(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn",
        F.concat(_pick(OPENINGS, F.col("conv_id") + F.col("turn")), F.col("text")).alias("question"),
        F.concat(_pick(STATEMENTS, F.col("conv_id") + F.col("turn")), F.col("text")).alias("statement"),
        "text",
    )


_Q = f"""WITH q AS (SELECT conv_id, turn, text, {_pick_sql(OPENINGS, 'conv_id + turn')} || text AS question,
  {_pick_sql(STATEMENTS, 'conv_id + turn')} || text AS statement FROM conversations)
"""


@query(
    "sql_gate",
    _Q + """, f AS (SELECT *, upper(regexp_extract(statement,
        '(?i)\\b(DROP|DELETE|UPDATE|INSERT|ALTER|TRUNCATE|CREATE|REPLACE|GRANT|REVOKE|MERGE)\\b', 1)) AS word FROM q)
      SELECT conv_id, turn, word = '' AS ok, coalesce(nullif(word, ''), '-') AS blocked FROM f""",
)
def sql_gate(spark, sf):
    return _questions(spark, sf).select(
        "conv_id", "turn",
        gates.is_read_only(F.col("statement")).alias("ok"),
        F.coalesce(gates.blocked_word(F.col("statement")), F.lit("-")).alias("blocked"),
    )


@query(
    "nl_gate",
    _Q + """SELECT conv_id, turn, regexp_matches(question,
      '(?i)\\b(remove|delete|drop|truncate|clear|erase|wipe|destroy|eliminate|insert|update|alter|create|replace)\\b') AS blocked,
      regexp_matches(question, '(?i)\\b(remove|delete|drop|truncate|clear|erase|wipe|destroy|eliminate)\\b') AS verb FROM q""",
)
def nl_gate(spark, sf):
    return _questions(spark, sf).select(
        "conv_id", "turn",
        gates.is_destructive_question(F.col("question")).alias("blocked"),
        gates.has_destructive_verb(F.col("question")).alias("verb"),
    )


@query(
    "table_request",
    _Q + """SELECT conv_id, turn, regexp_matches(question,
      '(?i)\\b(show|list|display|fetch|retrieve|find all|get all)\\b') AS wants_table FROM q""",
)
def table_request(spark, sf):
    return _questions(spark, sf).select(
        "conv_id", "turn", gates.asks_for_table(F.col("question")).alias("wants_table")
    )


@query(
    "user_limit_parse",
    _Q + """SELECT conv_id, turn, coalesce(TRY_CAST(nullif(regexp_extract(lower(question),
      '\\b(top|first|any|last)\\s+(\\d+)', 2), '') AS BIGINT), -1) AS n FROM q""",
)
def user_limit_parse(spark, sf):
    return _questions(spark, sf).select(
        "conv_id", "turn",
        F.coalesce(gates.requested_limit(F.col("question")), F.lit(-1)).alias("n"),
    )


@query(
    "number_from_text",
    """SELECT doc_id, coalesce(TRY_CAST(replace(regexp_extract(text, '(\\d[\\d,]*)', 1), ',', '') AS BIGINT), -1) AS n
      FROM documents""",
)
def number_from_text(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", F.coalesce(gates.number_in(F.col("text")), F.lit(-1)).alias("n")
    )


@query(
    "strip_fences",
    """SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body FROM documents""",
)
def strip_fences(spark, sf):
    fenced = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit(" ```sql\n"), F.col("text"), F.lit("\n``` \n"))
    ).otherwise(F.concat(F.col("text"), F.lit("\n")))
    return load(spark, sf, "documents").select(
        "doc_id", F.md5(gates.strip_fences(fenced)).alias("body")
    )


@query(
    "path_token",
    """WITH t AS (SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9_\\-]+', '_', 'g'), '_') AS tok FROM pages)
      SELECT page_id, CASE WHEN tok = '' THEN 'unknown' ELSE tok END AS token FROM t""",
)
def path_token(spark, sf):
    return load(spark, sf, "pages").select("page_id", gates.path_token(F.col("url")).alias("token"))


# ---------------------------------------------------------------- advisor answers


def _answers(spark, sf):
    """Answers of every shape, each carrying the whole text of a document as its reasoning."""
    d = load(spark, sf, "documents")
    k = F.col("doc_id")
    definition = F.from_json(F.lit('{"c":{"type":"string"}}'), "struct<c:struct<type:string>>")
    plain = F.to_json(
        F.struct(
            F.lit(" ALTER TABLE x ADD COLUMNS (c STRING) ").alias("SQL_FIX"),
            F.when(k % 3 != 0, definition).alias("NEW_JSON"),
            _pick(["info", "Critical ", "SEVERE", "WARNING"], k).alias("SEVERITY"),
            F.col("text").alias("REASONING"),
        )
    )
    answer = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(k % 5 == 1, F.concat(F.lit("["), plain, F.lit("]")))
        .when(k % 5 == 2, F.concat(F.lit("Sure: "), F.col("text")))
        .otherwise(plain)
    )
    return d.select("doc_id", answer.alias("answer"))


_PARSED = """WITH a AS (SELECT doc_id, text, doc_id % 5 NOT IN (1, 2) AS ok,
    ['INFO', 'CRITICAL', 'WARNING', 'WARNING'][(doc_id % 4 + 1)::INT] AS severity FROM documents)
"""


@query(
    "parse_response",
    _PARSED + """SELECT doc_id, ok, CASE WHEN ok THEN 'ALTER TABLE x ADD COLUMNS (c STRING)' ELSE '' END AS sql_fix,
      CASE WHEN ok AND doc_id % 3 <> 0 THEN '{"c":{"type":"string"}}' ELSE '{}' END AS new_json,
      CASE WHEN ok THEN severity ELSE 'WARNING' END AS severity,
      md5(CASE WHEN ok THEN text ELSE '' END) AS reasoning FROM a""",
)
def parse_response(spark, sf):
    parsed = policy.parse_responses(_answers(spark, sf), "answer", "r")
    return parsed.select(
        "doc_id", "r.ok", "r.sql_fix", "r.new_json", "r.severity", F.md5("r.reasoning").alias("reasoning")
    )


@query(
    "subtractive_guard",
    _PARSED + """, g AS (SELECT *, doc_id % 4 < 2 AS gone FROM a)
      SELECT doc_id, CASE WHEN ok AND NOT gone THEN 'ALTER TABLE x ADD COLUMNS (c STRING)' ELSE '' END AS sql_fix,
      CASE WHEN ok AND NOT gone AND doc_id % 3 <> 0 THEN '{"c":{"type":"string"}}' ELSE '{}' END AS new_json,
      CASE WHEN gone THEN 'CRITICAL' WHEN ok THEN severity ELSE 'WARNING' END AS severity FROM g""",
)
def subtractive_guard(spark, sf):
    parsed = policy.parse_responses(_answers(spark, sf), "answer", "r")
    only_gone = F.col("doc_id") % 4 < 2
    guarded = policy.subtractive_guard(
        F.col("r"), F.when(only_gone, 0).otherwise(F.col("doc_id") % 2), F.when(only_gone, 1).otherwise(0)
    )
    return parsed.select("doc_id", guarded.alias("g")).select(
        "doc_id", "g.sql_fix", "g.new_json", "g.severity"
    )


# ---------------------------------------------------------------- results


CONDITIONS = [
    "UNRESOLVED_COLUMN.WITH_SUGGESTION", "PARSE_SYNTAX_ERROR", "TABLE_OR_VIEW_NOT_FOUND", "DIVIDE_BY_ZERO",
    "MISSING_GROUP_BY", "INTERNAL_ERROR", "DATATYPE_MISMATCH.BINARY_OP_WRONG_TYPE", "UNRESOLVED_ROUTINE",
]


@query(
    "error_class",
    f"""WITH e AS (SELECT event_type, {_pick_sql(CONDITIONS, 'event_id')} AS condition FROM events)
      SELECT event_type, condition, CASE WHEN condition LIKE 'UNRESOLVED%' OR condition LIKE 'TABLE%' THEN 'schema'
        WHEN condition LIKE 'PARSE%' THEN 'syntax' WHEN condition LIKE 'INTERNAL%' THEN 'unknown' ELSE 'logic' END AS kind,
      count(*) AS n FROM e GROUP BY ALL""",
)
def error_class(spark, sf):
    log = load(spark, sf, "events").select(
        "event_type", _pick(CONDITIONS, F.col("event_id")).alias("condition")
    )
    counted = log.groupBy("event_type", "condition").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("kind", governed.error_class(F.col("condition")))


@query(
    "credibility",
    """WITH r AS (SELECT user_id, count(*) - 60 AS n, user_id % 2 = 0 AS is_count,
        round(max(CAST(value AS DECIMAL(18,2))) * 3, 2) AS pct FROM events GROUP BY user_id)
      SELECT user_id, NOT (n = 0 OR (is_count AND n > 1) OR pct > 100) AS credible, CASE WHEN n = 0 THEN 'empty result'
        WHEN is_count AND n > 1 THEN 'count with several rows' WHEN pct > 100 THEN 'percentage over 100'
        ELSE 'plausible' END AS reason FROM r""",
)
def credibility(spark, sf):
    results = load(spark, sf, "events").groupBy("user_id").agg(
        (F.count(F.lit(1)) - 60).alias("n"),
        F.round(F.max(F.col("value").cast("decimal(18,2)")) * 3, 2).alias("pct"),
    )
    verdict = governed.credibility(F.col("n"), F.col("user_id") % 2 == 0, F.col("pct"))
    return results.select("user_id", verdict.alias("v")).select("user_id", "v.credible", "v.reason")


@query(
    "judge_result",
    """SELECT count(*) > 0 AND max(share) <= 100 AS credible,
      CASE WHEN max(share) > 100 THEN 'percentage over 100' ELSE 'plausible' END AS reason
      FROM (SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS share FROM events GROUP BY 1)""",
)
def judge_result(spark, sf):
    shares = load(spark, sf, "events").groupBy("event_type").agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("share_pct")
    )
    return governed.judge(shares, is_count=False)


@query(
    "chart_series",
    "SELECT event_type AS x, count(*) AS y FROM events GROUP BY 1",
)
def chart_series(spark, sf):
    counts = load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))
    if not governed.is_graphable(counts):
        raise ValueError("a count per group must be chartable")
    return governed.chart_series(counts)


@query(
    "bounded_fetch",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem "
    "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100",
)
def bounded_fetch(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    ranked = lines.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return spark.createDataFrame(governed.fetch(ranked, 100))


@query(
    "governed_query",
    f"""SELECT {masking_queries.uuid_sql('c_custkey')} AS c_custkey, '***REDACTED***' AS c_name,
      {masking_queries.shifted_sql('o_orderdate', 'c_custkey')} AS o_orderdate, round(o_totalprice, 2) AS o_totalprice
      FROM (SELECT c_custkey, o_orderdate, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)""",
)
def governed_query(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    ranked = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .select("c_custkey", "c_name", "o_orderdate", "o_totalprice")
    )
    result = governed.govern(ranked, CONTRACT, "analyst", fm.secret(spark, masking_queries.KEY))
    return dates_as_text(result.rows)


@query(
    "governed_sql_targeted",
    "SELECT c_custkey, c_name, n_orders FROM (SELECT c_custkey, c_name, count(*) AS n_orders "
    "FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL ORDER BY n_orders DESC, c_custkey LIMIT 10)",
)
def governed_sql_targeted(spark, sf):
    governed.register_governed({t: load(spark, sf, t) for t in ("customer", "orders")}, "governed_")
    statement = """```sql
    SELECT c.c_custkey, c.c_name, count(*) AS n_orders FROM governed_customer c
    JOIN governed_orders o ON c.c_custkey = o.o_custkey
    GROUP BY c.c_custkey, c.c_name ORDER BY n_orders DESC, c.c_custkey LIMIT 10
    ```"""
    result = governed.governed_sql(
        spark, statement, CONTRACT, "doctor", fm.secret(spark, masking_queries.KEY), derived=("n_orders",)
    )
    return result.rows


@query(
    "governed_sql_aliases",
    f"""SELECT {masking_queries.uuid_sql('c_custkey')} AS c_nationkey, '***REDACTED***' AS o_orderstatus, n_orders
      FROM (SELECT c_custkey, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey
        GROUP BY ALL ORDER BY n_orders DESC, c_custkey LIMIT 50)""",
)
def governed_sql_aliases(spark, sf):
    # sensitive columns under the names of harmless ones are masked all the same
    governed.register_governed({t: load(spark, sf, t) for t in ("customer", "orders")}, "governed_")
    statement = """SELECT c.c_custkey AS c_nationkey, c.c_name AS o_orderstatus, count(*) AS n_orders
    FROM governed_customer c JOIN governed_orders o ON c.c_custkey = o.o_custkey
    GROUP BY c.c_custkey, c.c_name ORDER BY n_orders DESC, c.c_custkey"""
    result = governed.governed_sql(
        spark, statement, CONTRACT, "analyst", fm.secret(spark, masking_queries.KEY), derived=("n_orders",)
    )
    return result.rows


@query(
    "governed_union",
    f"""SELECT {masking_queries.uuid_sql('c_custkey')} AS who, '***REDACTED***' AS c_nationkey FROM
      (SELECT c_custkey FROM customer WHERE c_acctbal >= 5000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def governed_union(spark, sf):
    # branches of one origin are masked by it, under whatever name the first one gives
    governed.register_governed({"customer": load(spark, sf, "customer")}, "governed_")
    statement = """SELECT c_custkey AS who, c_name AS c_nationkey FROM governed_customer WHERE c_acctbal >= 5000
    UNION ALL SELECT c_custkey, c_name FROM governed_customer WHERE c_acctbal < 0 -- ; one statement"""
    result = governed.governed_sql(
        spark, statement, CONTRACT, "analyst", fm.secret(spark, masking_queries.KEY), limit=governed.HARD_CAP
    )
    return result.rows


@query(
    "governed_derived",
    """SELECT n_name AS nation, count(*) AS n, count(DISTINCT c_name) AS names, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS cents, 'UPDATE of ' || n_name AS note
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def governed_derived(spark, sf):
    # counts and what is made of open columns pass, sums of masked ones are vouched for
    governed.register_governed({"customer": load(spark, sf, "customer")}, "governed_")
    load(spark, sf, "nation").createOrReplaceTempView("open_nation")
    statement = """/* counts ' */ SELECT n_name AS nation, count(*) AS n, count(DISTINCT c_name) AS names, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents,
      concat('UPDATE of ', n_name) AS note
    FROM governed_customer JOIN open_nation ON c_nationkey = n_nationkey GROUP BY n_name"""
    result = governed.governed_sql(
        spark, statement, OPEN, "analyst", fm.secret(spark, masking_queries.KEY), derived=("cents",)
    )
    return result.rows


@query(
    "governed_renamed",
    f"""SELECT {masking_queries.uuid_sql('o_custkey')} AS o_orderstatus, {masking_queries.shifted_sql('last', 'o_custkey')} AS o_orderpriority
      FROM (SELECT o_custkey, o_orderdate AS last FROM orders WHERE o_orderkey % 50 = 0 ORDER BY o_orderkey LIMIT 10000)""",
)
def governed_renamed(spark, sf):
    # origins follow columns through names, subqueries and windows
    governed.register_governed({"orders": load(spark, sf, "orders")}, "governed_")
    statement = """WITH t AS (SELECT o_custkey AS a, o_orderdate AS b, o_orderkey AS k FROM governed_orders WHERE o_orderkey % 50 = 0)
    SELECT x.a AS o_orderstatus, x.b AS o_orderpriority FROM (SELECT a, b, k FROM t) x ORDER BY x.k"""
    result = governed.governed_sql(
        spark, statement, CONTRACT, "analyst", fm.secret(spark, masking_queries.KEY), limit=governed.HARD_CAP
    )
    return dates_as_text(result.rows)


@query(
    "governed_question",
    f"""SELECT {masking_queries.uuid_sql('c_custkey')} AS c_custkey, n_orders, true AS wants_table FROM (SELECT c_custkey, count(*) AS n_orders
      FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY n_orders DESC, c_custkey LIMIT 7)""",
)
def governed_question(spark, sf):
    # the limit comes from the question, the gate stands in front of both
    governed.register_governed({t: load(spark, sf, t) for t in ("customer", "orders")}, "governed_")
    statement = """SELECT c_custkey, count(*) AS n_orders FROM governed_customer JOIN governed_orders ON c_custkey = o_custkey
    GROUP BY c_custkey ORDER BY n_orders DESC, c_custkey"""
    result, table = governed.ask(
        spark, "Show the top 7 customers by orders", statement, CONTRACT, "analyst", fm.secret(spark, masking_queries.KEY)
    )
    return result.rows.withColumn("wants_table", F.lit(table))
