"""Personal data, and the terms that give it away.

Base patterns find protected values (email, ip, card, phone). What else in a text points to such a value is estimated
from the corpus: over all distinct lines, ``PMI(value; term) = log2(N * n(value, term) / (n(value) * n(term)))`` bits of the
``IC(value) = -log2(n(value) / N)`` bits that naming the value would give. A term discloses the share ``PMI / IC``. Terms
at ``REMOVE`` or above are removed, terms at ``GENERALISE`` or above are generalised, wherever they stand.

Copies of one document prove nothing about its words, also where they differ by a few: lines of one value are one *source*
if they are equal or follow or precede an equal line, through any number of copies. ``n(value)`` and ``n(value, term)``
count sources, ``n(term)`` and ``N`` distinct lines, and a term needs ``SUPPORT`` sources beside its value.

Rows are lines, pairs and terms, each counted with partial sums. A line gives values times terms rows, and values of a
line are few; no list grows with the corpus. Words of the whole corpus pass a filter first that is sized by the number of
candidate terms; a full filter lets more words through to the exact join, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import bit_filter, documents, in_bits, let, only, query, spans
from lakewarden.llm.components import components
from lakewarden.session import new_scratch

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. ``\G`` and the look-behind start a match at the head of a run or where the last match ended, the
#: only places where a leftmost match can start; possessive runs can't be re-tried. Same matches, linear time, no recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM, NO_TERM = r"\p{L}++", r"\P{L}++"
REMOVE, GENERALISE = 0.95, 0.8
#: Least sources of a pair of value and term.
SUPPORT = 2
#: Least characters of a neighbouring line that tells copies.
NEIGHBOUR_CHARS = 20
#: Most bits of the filter of terms.
FILTER_BITS = 1 << 22
#: Hash parts of the lines, of which one gives the first bounds of ``n(term)``.
PARTS = 16


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits fits."""

    def add(total: Column, place: Column) -> Column:
        d = F.substring(F.reverse(digits), place, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(place % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    fits = F.length(digits).between(13, 19)
    return F.when(fits, luhn(digits)).otherwise(F.lit(False))


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": spans(text, EMAIL),
        "ip": spans(text, IP, lambda m: m.rlike(_IP_PARTS)),
        "card": spans(text, CARD, _is_card),
        "phone": spans(text, PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
    }


def _suspect(text: Column) -> Column:
    """True wherever a base pattern may match, by one cheap search."""
    return text.rlike(r"@|[0-9][0-9.\x20()-]{5}")


def protected_lines(docs: DataFrame) -> DataFrame:
    """``line_hash``, hashes of the lines around it (``before``, ``behind``; null where they are short), ``values``, ``terms`` of
    every line that holds a protected value, copies included."""

    def around(lines: Column) -> Column:
        long = lambda l: F.when(F.length(F.trim(l)) >= NEIGHBOUR_CHARS, F.xxhash64(l))
        row = lambda l, i: F.struct(l.alias("line"), long(F.get(lines, i - 1)).alias("before"), long(F.get(lines, i + 1)).alias("behind"))
        return F.filter(F.transform(lines, row), lambda r: _suspect(r["line"]))

    lines = docs.filter(_suspect(F.col("text"))).select(F.inline(let(F.split("text", "\n"), around)))
    found = base_spans(F.col("line"))

    def value_of(kind: str) -> Column:
        plain = F.lower if kind in ("email", "ip") else _digits
        return F.transform(found[kind], lambda s: F.concat(F.lit(kind + "="), plain(s["found"])))

    values = F.array_distinct(F.concat(*map(value_of, KINDS)))
    rest = F.col("line")
    for pattern in (EMAIL, IP, CARD, PHONE):
        rest = F.regexp_replace(rest, pattern, " ")
    terms = F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(TERM), F.lit(0)), F.lower))
    return lines.select(
        F.xxhash64("line").alias("line_hash"), "before", "behind", values.alias("values"), terms.alias("terms")
    ).filter(F.size("values") > 0)


def sources(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """``value``, ``source``, ``terms`` of the distinct lines of every value, as a written table."""
    distinct = lines.dropDuplicates(["line_hash", "before", "behind"]).select(F.explode("values").alias("value"), "line_hash", "before", "behind", "terms")
    path = new_scratch(spark, "value-lines")
    distinct.withColumn("node", F.xxhash64("value", "line_hash", "before", "behind")).write.parquet(path)
    rows = spark.read.parquet(path)
    marks = F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64("value", F.lit(c), c)) for c in ("line_hash", "before", "behind")])
    marked = rows.select("node", F.explode(marks).alias("mark")).filter("mark is not null")
    hubs = marked.groupBy("mark").agg(F.min("node").alias("v"))
    found = components(spark, marked.join(hubs, "mark").select(F.col("node").alias("u"), "v"))
    out = new_scratch(spark, "value-sources")
    of_node = found.select("node", F.col("component").alias("source"))
    rows.join(of_node, "node", "left").select("value", F.coalesce("source", "node").alias("source"), "terms").write.parquet(out)
    return spark.read.parquet(out)


def all_lines(docs: DataFrame) -> DataFrame:
    """``line`` and ``line_hash`` of every line; a null text is one empty line."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.select("line", F.xxhash64("line").alias("line_hash"))


def term_counts(lines: DataFrame, words: list[list[int]]) -> DataFrame:
    """``term`` and ``n_term``, its distinct lines, of every term that the filter lets through."""
    return (
        lines.select("line_hash", F.explode(F.array_distinct(F.split("line", NO_TERM))).alias("term"))
        .select("line_hash", F.lower("term").alias("term"))
        .filter(in_bits(F.col("term"), words))
        .distinct()
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )


def disclosing_terms(spark: SparkSession, docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """``term``, ``share`` and ``action`` of every term that gives a protected value away, as a written table."""
    path = new_scratch(spark, "protected-lines")
    protected_lines(docs).write.parquet(path)
    by_value = sources(spark, spark.read.parquet(path))
    n_value = by_value.groupBy("value").agg(F.countDistinct("source").alias("n_value"))
    pairs_path = new_scratch(spark, "disclosure-pairs")
    (
        by_value.select("value", "source", F.explode("terms").alias("term"))
        .distinct()
        .groupBy("value", "term")
        .agg(F.count("*").alias("n_pair"))
        .filter(F.col("n_pair") >= SUPPORT)
        .join(n_value, "value")
        .groupBy("term", "n_value", "n_pair")  # however many values a term stands beside, their counts are few
        .agg(F.count("*").alias("n_values"))
        .write.parquet(pairs_path)
    )
    pairs = spark.read.parquet(pairs_path)
    total = all_lines(docs).select("line_hash").distinct().count()

    def disclosing(rows: DataFrame, n_term: Column) -> DataFrame:
        """``term`` and ``share`` of the terms that disclose if they stand in ``n_term`` lines."""
        pmi = F.log2(F.lit(float(total)) * F.col("n_pair") / (F.col("n_value") * n_term))
        ic = F.log2(F.lit(float(total)) / F.col("n_value"))
        share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
        return rows.groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= generalise)

    part = all_lines(docs).filter(F.pmod("line_hash", F.lit(PARTS)) == 0)
    at_least = term_counts(part, bit_filter(pairs.select("term").distinct(), "term", FILTER_BITS))
    left_path = new_scratch(spark, "terms-left")
    disclosing(pairs.join(at_least, "term", "left"), F.coalesce("n_term", F.lit(1))).write.parquet(left_path)
    n_term = term_counts(all_lines(docs), bit_filter(spark.read.parquet(left_path), "term", FILTER_BITS))
    out_path = new_scratch(spark, "disclosing-terms")
    (
        disclosing(pairs.join(n_term, "term"), F.col("n_term"))
        .withColumn("action", F.when(F.col("share") >= remove, "remove").otherwise("generalise"))
        .write.parquet(out_path)
    )
    return spark.read.parquet(out_path)


def joined(lists: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""

    def tagged(kind: str, found: Column) -> Column:
        return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[tagged(*x) for x in lists]), ",")


def sanitised_spans(spark: SparkSession, docs: DataFrame, **thresholds) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, lists of spans per base kind, ``generalise`` and ``remove``.

    A span has ``start``, ``end`` (code points, end exclusive) and ``found``. Terms inside a base span are left to it.
    Null and empty texts have no spans. Repeated rows get the same spans; rows with one id and different texts are told
    apart by a hash of the text.
    """
    terms = disclosing_terms(spark, docs, **thresholds)
    words = bit_filter(terms, "term", FILTER_BITS)
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = lambda t: in_bits(F.lower(t), words)
    lists = base_spans(text)
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), *[lists[k].alias(k) for k in KINDS])
    if not any(words[0]):
        hits = None
    else:
        some = F.exists(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), hit)  # places are only worked out where there are any
        hits = docs.filter(some).select("doc_id", F.xxhash64(text).alias("text_hash"), F.explode(spans(text, TERM, hit)).alias("span"))
        hits = (
            hits.withColumn("term", F.lower("span.found"))
            .join(terms.select("term", "action"), "term")  # before any shuffle of words, where the terms are few
            .groupBy("doc_id", "text_hash")
            .agg(F.sort_array(F.collect_set(F.struct("span.start", "span.end", "span.found", "action"))).alias("hits"))
        )  # a list of words of one text
    none = F.array().cast("array<struct<start:int,end:int,found:string,action:string>>")
    if hits is None:
        out = base.withColumn("hits", none)
    else:
        same = base["doc_id"].eqNullSafe(hits["doc_id"]) & (base["text_hash"] == hits["text_hash"])
        out = base.join(hits, same, "left").select(base["*"], F.coalesce(hits["hits"], none).alias("hits"))
    taken = F.concat(*[F.col(k) for k in KINDS])
    free = F.filter("hits", lambda h: ~F.exists(taken, lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    out = out.withColumn("hits", free)
    pick = lambda action: F.transform(
        F.filter("hits", lambda h: h["action"] == action), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["found"].alias("found"))
    )
    return out.select("doc_id", *KINDS, pick("generalise").alias("generalise"), pick("remove").alias("remove"))


@query("op5_disclosure")
def op5_disclosure(spark, sf_dir):
    out = sanitised_spans(spark, only(documents(spark, sf_dir)))
    base = [(k, F.col(k)) for k in KINDS]
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined([*base, ("generalise", F.col("generalise")), ("remove", F.col("remove"))]).alias("spans"),
    )
