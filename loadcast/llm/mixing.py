"""Mixing sources to target weights by a low-discrepancy schedule of blocks.

The words of each source, its documents shuffled by a hash of their ids, form a
stream that is cut into blocks of equally many words.  Slot k of the mix falls
on the point of the van der Corput sequence with the index k; the cumulative
targets map that point to a source, and the slot's rank within its source names
the block, counted on from the start of the stream when that is used up.  Every
prefix of the schedule is therefore close to the target shares.  A source takes
its target, rounded to whole words, and no more: the last block is used in part,
slots beyond it are left out, and blocks that the points have not reached (a
source of less than a block may meet no point at all) get slots evenly between.

Defined results: a null text has no words and takes part with size 0; a null
source is a source of its own and comes last; rows that repeat an id are
documents of their own; rows without an id are shuffled by a hash of their text;
an empty table gives an empty table; columns besides the id, text and source are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.llm.text import BLANK, WORD, numbered, row_key, word_count
from loadcast.sources.scratch import materialize

# Fixed values of the mix: weights by rank of the source, share of all words, most uses.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2

BLOCK_WORDS = 64
POINT_BITS = 48
POINT_BINS = 4096
CHUNK_SLOTS = 65536


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """One narrow row per document, with the columns to keep."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))
    return docs.select(
        *keep,
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        key.alias("shuffled"),
        F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("bucket"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """Per source: size and target; one row per source, so windows over all of them are small.

    Sources under their cap share what the capped ones leave, by weight.  In the
    order of cap over weight the first source that stays below its cap fixes the
    words per unit of weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(SHARE) - F.col("before")) / F.col("rest")
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("room"))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", rank)
        .withColumns({"weight": weight, "cap": F.col("source_size") * REPEATS})
        .withColumns({"before": before, "rest": rest, "room": F.row_number().over(by_room)})
        .withColumn("level", level)
        .withColumn("level", F.min_by("level", free).over(every))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "sid", "source_size", "target")
    )


def point(k: Column) -> Column:
    """Van der Corput point of a slot: its bits mirrored at the binary point."""
    mirrored = F.reverse(F.lpad(F.bin(k), POINT_BITS, "0"))
    return F.conv(mirrored, 2, 10).cast("long") / F.lit(float(1 << POINT_BITS))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix in order: slot, sid, block, lap (uses of the block before), words used of the block.

    Slots meet sources by an equi-join on bins of the unit interval, and ranks
    are counted in chunks, so neither step gathers a source in one task.
    """
    spark = sources.sparkSession
    quotas = sources.withColumn("quota", F.round("target").cast("long")).filter("quota > 0")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    count = -(-total // block_words)
    laps = F.floor(F.col("quota") / F.col("source_size"))
    ends = F.ceil((F.col("quota") - laps * F.col("source_size")) / block_words)
    blocks = F.ceil(F.col("source_size") / block_words)
    quotas = quotas.withColumns({"blocks": blocks, "need": laps * blocks + ends})
    upto = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    spans = quotas.withColumn("upto", upto).select(
        "sid",
        ((F.col("upto") - F.col("quota")) / F.lit(float(total or 1))).alias("low"),
        (F.col("upto") / F.lit(float(total or 1))).alias("high"),
    )
    bins = spans.withColumn(
        "bin",
        F.explode(F.sequence(F.floor(F.col("low") * POINT_BINS), F.least(F.floor(F.col("high") * POINT_BINS), F.lit(POINT_BINS - 1)))),
    )
    slots = (
        spark.range(count)
        .select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
        .withColumn("bin", F.floor(F.col("u") * POINT_BINS))
        .join(bins, "bin")
        .filter("low <= u and u < high")
        .withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    )
    earlier = F.sum("count").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counted = slots.groupBy("sid", "chunk").count()
    bases = counted.withColumn("base", F.coalesce(earlier, F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1 + F.col("base")
    ranked = slots.join(bases, ["sid", "chunk"]).select("slot", "sid", rank.cast("long").alias("rank"))
    met = counted.groupBy("sid").agg(F.sum("count").alias("met"))
    unmet = (
        quotas.join(met, "sid", "left")
        .withColumn("met", F.coalesce("met", F.lit(0)))
        .filter("met < need")
        .select("sid", "need", F.explode(F.sequence(F.col("met"), F.col("need") - 1)).alias("rank"))
        .select(F.floor((F.col("rank") + 0.5) / F.col("need") * count).alias("slot"), "sid", "rank")
    )
    block, lap = F.col("rank") % F.col("blocks"), F.floor(F.col("rank") / F.col("blocks"))
    used = F.least(F.lit(block_words), F.col("quota") - F.col("lap") * F.col("source_size") - F.col("block") * block_words)
    return (
        ranked.unionByName(unmet)
        .join(quotas, "sid")
        .filter("rank < need")
        .select("slot", "sid", block.alias("block"), lap.alias("lap"), "quota", "source_size")
        .select("slot", "sid", "block", "lap", used.alias("used"))
    )


def positions(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their place in the shuffled stream of their source."""
    known = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    before = F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = known.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(before, F.lit(0))).drop("words")
    within = Window.partitionBy("sid", "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return known.join(base, ["sid", "bucket"]).withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size")).drop("base")


def pieces(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Word ranges that the mix takes: sid, start of the document, lap, low, high, first slot."""
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = placed.filter("size > 0").select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    high = F.least(F.col("block") * block_words + F.col("used") - F.col("start"), F.col("size"))
    return (
        parts.join(slots, ["sid", "block"])
        .filter(high > low)
        .groupBy("sid", "start", "lap")
        .agg(F.min(low).alias("low"), F.max(high).alias("high"), F.min("slot").alias("slot"))
    )


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes."""
    sized = materialize(sizes(docs), "mix-sizes")
    sources = materialize(targets(sized), "mix-sources")
    placed = positions(sized, sources)
    taken = pieces(placed, schedule(sources, block_words), block_words).groupBy("sid", "start").agg(F.sum(F.col("high") - F.col("low")).alias("got"))
    at = F.when(F.col("size") > 0, F.col("start"))  # the start is unique among documents with words
    return (
        placed.withColumn("at", at)
        .join(taken.withColumnRenamed("start", "at"), ["sid", "at"], "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed documents: one row, with the columns of ``docs``, per use of a document.

    A use that covers part of a document holds exactly those words and the white
    space after each.  ``n_chars``, if present, follows the text.
    """
    names = docs.columns
    keyed = docs.withColumn("_key", row_key("doc_id", "source", "text"))
    sized = materialize(numbered(sizes(keyed, "_key"), "_key", "_nth"), "mix-sizes")
    sources = materialize(targets(sized), "mix-sources")
    placed = materialize(positions(sized, sources), "mix-places")
    uses = pieces(placed, schedule(sources, block_words), block_words)
    where = placed.filter("size > 0").select("_key", "_nth", "sid", "start", "size").join(uses, ["sid", "start"]).drop("sid", "start")
    where = where.select("_key", "_nth", F.col("size").alias("_size"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    cut = F.regexp_extract_all("text", F.lit(f"(?:^[{BLANK}]+)?{WORD}[{BLANK}]*"), F.lit(0))
    part = F.array_join(F.slice(cut, (F.col("_low") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int")), "")
    text = F.when(F.col("_high") - F.col("_low") == F.col("_size"), F.col("text")).otherwise(part)
    mixed = numbered(keyed, "_key", "_nth").join(where, ["_key", "_nth"]).withColumn("text", text)
    if "n_chars" in names:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(names)

