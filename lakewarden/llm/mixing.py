"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: every source has a weight and may give at most ``MAX_EPOCHS`` times its size; what is above goes to the others
by weight. The documents of a source are shuffled by a hash and laid end to end, and that stream of words is cut into
equal blocks. Slot ``i`` of the schedule is the golden-ratio point ``frac(i * phi)``, kept as integers; it falls into
the cumulative share of one source. The slot's rank among the slots of its source, modulo the source's blocks, is the
block it takes. So a source's slots are spread evenly over the schedule, and its blocks are drawn equally often, plus
or minus one.

Nothing is ordered globally: prefix sums over documents and ranks over slots go by lane first (a bounded number of
lanes per source) and add up the lanes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakewarden.llm.common import WORD, col, documents, free_name, query
from lakewarden.session import new_scratch

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Words of a block in a large source, and blocks that a source is cut into at least (never below a word each).
BLOCK_WORDS = 4096
LEAST_BLOCKS = 4096
#: Lanes of a source's documents and slots of one lane of the schedule.
LANES = 1024
#: Cells of the grid on which points meet sources, at least.
GRID = 4096
LANE_SLOTS = 1 << 14
#: Points of the golden-ratio sequence are multiples of 2**-31; the multiplier is odd and next to 2**31 / phi.
POINT_BITS = 31
GOLDEN = 1327217885


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words) and the place in the shuffle, for ``doc_id``, ``source``, ``text``."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(8), F.col("doc_id").cast("long"), F.col("text")).alias("at"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` of every source.

    With sources in order of how soon they stop (``most * size / weight``), those that stop are the first few: the
    excess is shared out again and again until the next one no longer stops. That point is found from running sums, so
    one pass over the sources does it. The rows are sources, already summed; their texts are not touched.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # names compare as UTF-8 bytes, which is code point order; null last
    named = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("stop", F.col("source_size") * float(most))
    ratio = F.col("stop") / F.col("weight")
    soonest = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    whole = soonest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # share of a unit of weight if this source and all later ones don't stop
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("unit", left / weights_left).withColumn("holds", ratio >= F.col("unit"))
    # the unit falls from one holding source to the next, so the first has the largest
    per = per.withColumn("level", F.max(F.when(F.col("holds"), F.col("unit"))).over(whole))
    return per.select(
        "source", "source_size", F.when(F.col("holds"), F.least("stop", F.col("weight") * F.col("level"))).otherwise(F.col("stop")).alias("target")
    )


def plan_sources(spark: SparkSession, rows: DataFrame, **rules) -> DataFrame:
    """Targets, and the blocks and cumulative slot shares of each source, as a written table of one row per source."""
    goal = targets(rows, **rules)
    blocks = F.least(
        F.greatest(F.lit(LEAST_BLOCKS).cast("long"), F.ceil(F.col("source_size") / BLOCK_WORDS)), F.greatest(F.col("source_size"), F.lit(1).cast("long"))
    ).cast("long")
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (
        goal.withColumn("blocks", blocks)
        .withColumn("wanted", wanted)
        .withColumn("number", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
        .withColumn("upto", F.sum("wanted").over(upto))
        .withColumn("slots", F.round(F.sum("wanted").over(everything)).cast("long"))
        .withColumn("all", F.sum("wanted").over(everything))
        .withColumn("from", F.when(F.col("all") > 0, (F.col("upto") - F.col("wanted")) / F.col("all")).otherwise(F.lit(0.0)))
        .withColumn("to", F.lead("from", 1, 2.0).over(Window.orderBy(F.col("source").asc_nulls_last())))
    )
    path = new_scratch(spark, "mix-sources")
    out.write.parquet(path)
    return spark.read.parquet(path)


def schedule(spark: SparkSession, sources: DataFrame, most: int = MAX_EPOCHS) -> DataFrame:
    """``slot``, ``number`` (of the source), ``rank``, ``block``: which block every slot takes, in slot order by ``slot``."""
    total = sources.agg(F.max("slots")).first()[0] or 0
    slot = F.col("id")
    modulus = 1 << POINT_BITS
    point = ((slot % modulus) * GOLDEN % modulus) / float(modulus)
    # a source owns the points from the share before it up to its own; a grid of cells makes that an equal join
    owned = sources.filter("wanted > 0").select("number", "blocks", "from", "to")
    cells = max(GRID, 4 * sources.count())
    cut = lambda share: F.least(F.floor(F.col(share) * cells), F.lit(cells - 1)).cast("long")
    owners = owned.select("*", F.explode(F.sequence(cut("from"), cut("to"))).alias("cell"))
    points = spark.range(0, total, 1, max(1, -(-total // (LANE_SLOTS * 16)))).select(
        slot.alias("slot"), F.expr(f"id div {LANE_SLOTS}").alias("lane"), point.alias("point")
    )
    points = points.withColumn("cell", F.floor(F.col("point") * cells).cast("long"))
    taken = points.join(owners, "cell").filter("point >= from and point < to").select("slot", "lane", "number", "blocks")
    before = Window.partitionBy("number").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = taken.groupBy("number", "lane").count().select(
        "number", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("number", "lane").orderBy("slot")) - 1
    ranked = taken.withColumn("inside", inside).join(lanes, ["number", "lane"])
    rank = F.col("start") + F.col("inside")
    return (
        ranked.withColumn("rank", rank)
        .filter(F.col("rank") < F.col("blocks") * most)  # a block more often than that would pass the limit
        .select("slot", "number", "rank", (F.col("rank") % F.col("blocks")).alias("block"))
    )


def laid_out(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with ``start``, their first word's place in the shuffled stream of their source."""
    own = sources.select("source", "number", "source_size", "target", "blocks")
    known = rows.join(own, rows["source"].eqNullSafe(own["source"])).select(
        "doc_id", "size", "at", "number", "source_size", "target", "blocks", F.pmod(F.shiftright("at", 40), F.lit(LANES)).alias("lane")
    )
    order = ["at", "doc_id", "size"]
    before = Window.partitionBy("number").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = known.groupBy("number", "lane").agg(F.sum("size").alias("words")).select(
        "number", "lane", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("lane_start")
    )
    inside = F.sum("size").over(Window.partitionBy("number", "lane").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        known.withColumn("inside", inside - F.col("size"))
        .join(lanes, ["number", "lane"])
        .withColumn("start", (F.col("lane_start") + F.col("inside")).cast("long"))
        .drop("lane", "lane_start", "inside")
    )


def pieces(laid: DataFrame) -> DataFrame:
    """One row per document and block that it reaches into, with the words it has there; none for empty documents.

    Block ``b`` holds the words from ``b * source_size div blocks`` on. Products go through decimals: a stream position
    times a number of blocks can pass a long.
    """
    low = F.expr("greatest(0L, (cast(start as decimal(20,0)) * blocks) div source_size - 1)")
    high = F.expr("least(blocks - 1, (cast(start + size as decimal(20,0)) * blocks) div source_size + 1)")
    out = laid.filter("size > 0").select("*", F.explode(F.sequence(low, high)).alias("block"))
    begins = F.expr("(cast(block as decimal(20,0)) * source_size) div blocks")
    ends = F.expr("(cast(block + 1 as decimal(20,0)) * source_size) div blocks")
    held = F.least(ends, F.col("start") + F.col("size")) - F.greatest(begins, F.col("start"))
    return out.withColumn("held", held).filter("held > 0")


def mixed(spark: SparkSession, docs: DataFrame, **rules) -> DataFrame:
    """``doc_id``, ``at``, ``size``, ``source_size``, ``target``, ``taken`` for every row of ``docs`` (``doc_id``, ``source``, ``text``).

    ``at`` is the row's place in the shuffle, a hash of id and text.

    ``taken`` counts the words that the schedule draws from the document, repeats included. Null and empty texts have
    size 0 and nothing taken; a null source is a source of its own, last in order. Repeated rows lie next to each other
    in the stream and are drawn like any two documents. An empty table gives no rows.
    """
    path = new_scratch(spark, "mix-documents")
    sized(docs).write.parquet(path)
    rows = spark.read.parquet(path)
    sources = plan_sources(spark, rows, **rules)
    laid = laid_out(rows, sources)
    draws = schedule(spark, sources, rules.get("most", MAX_EPOCHS)).groupBy("number", "block").agg(F.count("*").alias("times"))
    # (source, first word) tells every row with words from any other
    drawn = (
        pieces(laid)
        .join(draws, ["number", "block"], "left")
        .groupBy("number", "start", "doc_id", "at", "size", "source_size", "target")
        .agg(F.sum(F.col("held") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    )
    columns = ["doc_id", "at", "size", "source_size", "target", "taken"]
    return drawn.select(*columns).unionByName(laid.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


def repeated(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix as documents: every row of ``docs`` as often as its words are taken, to the nearest whole number.

    Columns as before. Rows of which less than half is taken, and rows without words, go. Equal rows share what is taken
    of them together.
    """
    named = docs.select(col(doc_id).cast("long").alias("doc_id"), col(source).alias("source"), col(text).alias("text"))
    times, key, at = (free_name(docs.columns, w) for w in ("times", "mixed_id", "mixed_at"))
    drawn = (
        mixed(spark, named)
        .groupBy(F.col("doc_id").alias(key), F.col("at").alias(at))
        .agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias(times))
        .filter(F.col(times) > 0)
    )
    mine = F.xxhash64(F.lit(8), col(doc_id).cast("long"), col(text))
    joined = docs.join(drawn, col(doc_id).cast("long").eqNullSafe(F.col(key)) & (mine == F.col(at)))
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(times, key, at)


@query("op8_source_mix")
def op8_source_mix(spark, sf_dir):
    return mixed(spark, documents(spark, sf_dir).select("doc_id", "source", "text")).drop("at")
