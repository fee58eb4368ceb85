"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's word shingles, in order; fewer if the text has fewer.
The sketch of a union is the ``k`` smallest of both sketches together, so parts of a text or of a corpus merge. From
sketches come the resemblance and containment of two shingle sets and the number of distinct shingles of one.

All of it is expressions over one row. Neighbours by id meet through a window over buckets of an id range; the first row
of a bucket is lent to the bucket before, so there is no global order and the texts are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lakewarden.llm.common import documents, let, only, query, words
from lakewarden.session import small_frame

K = 128
SHINGLE = 5
#: Rows of an id bucket that are aimed at, and most buckets there can be: their heads are the only broadcast.
BUCKET_ROWS = 64
MOST_BUCKETS = 1 << 14


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter; none for a text without words."""

    def runs(h: Column) -> Column:
        whole = F.transform(
            F.slice(h, F.lit(1), F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)])
        )
        return F.when(F.size(h) >= width, whole).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), runs)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct shingle hashes, ascending; empty for null texts and texts without words."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: Column, k: int = K) -> Column:
    """Sketch of the union, from an array of sketches."""
    return F.aggregate(sketches, F.array().cast("array<bigint>"), lambda all_, one: merge(all_, one, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over the size of the union; two empty sketches are alike."""

    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), u))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return let(merge(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 for an empty ``a``."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Sketch as text: its hashes as 8 bytes each, base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def with_next(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows of ``docs`` (``doc_id``, ``text``) with ``bucket`` and ``borrowed``, and the window in which ``lead`` is the
    next document by falling id; after the last comes the first.

    Rows without an id come last. Rows of one id follow each other by a hash of their text. Borrowed rows only serve as
    the next of another and have to be dropped after the window.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    place = F.coalesce(F.col("doc_id"), F.lit(low - 1).cast("long"))
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS))
    width = -(-(high - low + 2) // buckets)
    placed = docs.select("doc_id", "text", place.alias("place"), F.xxhash64("text").alias("tie"))
    bucket = F.floor((F.col("place").cast("decimal(20,0)") - F.lit(low - 1)) / F.lit(width)).cast("long")
    ids = docs.select(place.alias("place")).withColumn("bucket", bucket)
    heads = [tuple(r) for r in ids.groupBy("bucket").agg(F.max("place")).orderBy(F.desc("bucket")).collect()]
    lent = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]  # the first one's goes round to the last bucket
    schema = T.StructType([T.StructField("head", T.LongType()), T.StructField("lend_to", T.LongType())])
    marked = placed.withColumn("bucket", bucket)
    if lent:
        marked = marked.join(F.broadcast(small_frame(spark, lent, schema)), F.col("place") == F.col("head"), "left")
    else:
        marked = marked.withColumn("lend_to", F.lit(None).cast("long"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("borrowed"))
    copy = F.struct(F.col("lend_to").alias("bucket"), F.lit(True).alias("borrowed"))
    rows = marked.select(
        "doc_id", "text", "place", "tie", F.explode(F.when(F.col("lend_to").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("in")
    ).select("doc_id", "text", "place", "tie", "in.bucket", "in.borrowed")
    return rows, Window.partitionBy("bucket").orderBy("borrowed", F.desc("place"), "tie")


def compared(spark: SparkSession, docs: DataFrame, k: int = K) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): sketches of the text, of its edited text and of the next document.

    The edited text ends in the head of the next document. Null texts are empty ones; repeated rows are each a document.
    A table of one document is its own next. An empty table gives no rows.
    """
    rows, order = with_next(spark, docs)
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("sketch", sketch(F.col("text"), k)).withColumn("edited_sketch", sketch(F.col("edited"), k))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "bucket", "borrowed", "place", "tie")
    return rows.withColumn("next_sketch", F.lead("sketch").over(order)).filter(~F.col("borrowed"))


@query("op1_fingerprints")
def op1_fingerprints(spark, sf_dir):
    out = compared(spark, only(documents(spark, sf_dir)))
    return out.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.round(distinct_shingles(F.col("sketch"))).cast("long").alias("distinct_shingles"),
    )
