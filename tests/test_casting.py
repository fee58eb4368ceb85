import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.functions import casting, filters, text
from lakewarden.functions.types import types_compatible
from lakewarden.operators import quality


def one(spark, column):
    return spark.range(1).select(column.cast("string").alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, day",
    [("2020-01-15", "2020-01-15"), ("bad", None), ("1987-03-02abc", None), ("2020-13-40", None), (None, None), ("", None)],
)
def test_dates(spark, raw, day):
    assert one(spark, casting.safe_date(F.lit(raw).cast("string"))) == day


@pytest.mark.parametrize(
    "raw, stamp",
    [
        ("2020-01-15T08:30:00+00:00", "2020-01-15 08:30:00"), ("2020-01-15T08:30:00Z", "2020-01-15 08:30:00"),
        ("2020-01-15T08:30:00", "2020-01-15 08:30:00"), ("2020-01-15 08:30:00", "2020-01-15 08:30:00"),
        ("2020-01-15T10:30:00+02:00", "2020-01-15 08:30:00"), ("bad", None), (None, None),
    ],
)
def test_timestamps(spark, raw, stamp):
    assert one(spark, casting.safe_timestamp(F.lit(raw).cast("string"))) == stamp


@pytest.mark.parametrize("raw, number", [("12", "12"), ("12 mg", None), (None, None)])
def test_numbers(spark, raw, number):
    c = F.lit(raw).cast("string")
    assert one(spark, casting.safe_long(c)) == number
    assert one(spark, casting.safe_double(c)) == (None if number is None else "12.0")


def test_name_collision(spark):
    with pytest.raises(ValueError, match="a_b"):
        casting.normalize_names(spark.createDataFrame([(1, 2)], T.StructType(
            [T.StructField("A b", T.LongType()), T.StructField("a-b", T.LongType())])))


def test_cast_leaves_strings_and_strangers(spark):
    df = spark.createDataFrame([("1", "x", "y")], "n string, s string, other string")
    out = casting.cast_to_contract(df, {"n": "long", "s": "string", "absent": "date"})
    assert out.dtypes == [("n", "bigint"), ("s", "string"), ("other", "string")]


@pytest.mark.parametrize(
    "name, stamped",
    [("start", True), ("stop", True), ("date", True), ("visit_date", True), ("birthdate", False),
     ("candidate", False), ("date_id", False), ("validated", False), ("uuid", False)],
)
def test_timestamp_names(name, stamped):
    assert casting.looks_like_timestamp(name) is stamped


@pytest.mark.parametrize(
    "expected, incoming, fits",
    [("date", "string", True), ("string", "date", False), ("int", "bigint", True), ("long", "int", True),
     ("double", "decimal(12,4)", True), ("double", "float", True), ("double", "int", False),
     ("boolean", "string", True), ("unknown", "unknown", True), ("unknown", "string", False)],
)
def test_compatibility(spark, expected, incoming, fits):
    assert one(spark, types_compatible(F.lit(expected), F.lit(incoming))) == str(fits).lower()


def test_empty_frame_profile(spark):
    empty = spark.createDataFrame([], "a string, b double")
    rows = quality.null_profile(empty).collect()
    assert [(r["column"], r["row_count"], r["null_pct"]) for r in rows] == [("a", 0, 0.0), ("b", 0, 0.0)]
    assert quality.cast_loss(empty, {"a": "long"}).first()["warn"] is False


@pytest.mark.parametrize(
    "question, n",
    [("show top 20 patients", "20"), ("last 3 visits", "3"), ("how many", None), ("stop 5", None), ("ANY  7", "7")],
)
def test_limits(spark, question, n):
    assert one(spark, text.requested_limit(F.lit(question))) == n


@pytest.mark.parametrize(
    "answer, n", [("There are 18,574 patients.", "18574"), ("none", None), ("7, maybe 8", "7")]
)
def test_numbers_in_text(spark, answer, n):
    assert one(spark, text.number_in(F.lit(answer))) == n


@pytest.mark.parametrize(
    "raw, bare",
    [("```sql\nSELECT 1\n```", "SELECT 1"), ("  SELECT 1 ", "SELECT 1"), ("```\nSELECT 1```", "SELECT 1"),
     ("SELECT '```' AS x", "SELECT '```' AS x")],
)
def test_fences(spark, raw, bare):
    assert one(spark, text.strip_fences(F.lit(raw))) == bare


@pytest.mark.parametrize(
    "statement, single",
    [("SELECT 1", True), ("with a as (select 1) select * from a;", True), ("SELECT ';' AS x", True),
     ("SELECT 1; SELECT 2", False), ("SHOW TABLES", False), ("-- c\nSELECT 1", True), ("SELECT 1 -- ; x", True)],
)
def test_single_query(spark, statement, single):
    assert one(spark, text.starts_as_query(F.lit(statement))) == str(single).lower()


@pytest.mark.parametrize("token, clean", [("My Table!", "my_table"), ("", "unknown"), ("__", "unknown"), ("a-b_c", "a-b_c")])
def test_tokens(spark, token, clean):
    assert one(spark, text.path_token(F.lit(token))) == clean


def test_unknown_filter_operator():
    with pytest.raises(ValueError, match="BETWEEN"):
        filters.intent_predicate(None, "BETWEEN", 1)


def test_shapes_agree_with_trying_every_format(spark):
    """Picking the parser by shape gives what trying the formats in order gives."""
    days = ["2020-01-15", "2020-1-15", "0000-01-01", "+12020-01-15", "12020-01-15", "-2020-01-15", "2020-02-30", "20200115", ""]
    joints = ["T", " ", "t", "  ", "", "TT"]
    clocks = ["08:30:00", "8:30:00", "24:00:00", "08:30", "08:30:00.5", "23:59:60", ""]
    zones = ["", "Z", "+00:00", "-05:30", "+0000", "+25:00", "z", " Z", "+00:00:00", "UTC"]
    texts = [(d + j + c + z,) for d in days for j in joints for c in clocks for z in zones]
    texts += [(f" {days[0]}",), (f"{days[0]}\n",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    tried = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in casting.TIMESTAMP_FORMATS])
    differs = df.filter(~casting.safe_timestamp(F.col("t")).eqNullSafe(tried))
    assert differs.collect() == []
    differs = df.filter(~casting.safe_date(F.col("t")).eqNullSafe(F.try_to_date("t", casting.DATE_FORMAT)))
    assert differs.collect() == []
