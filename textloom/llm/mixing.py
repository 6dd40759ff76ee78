"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, a cut at the exact budget.

All of it is built-in functions. A source's rows fall into ranges of a random key, as many as its rows ask for, so that a hot source has many
ranges; sizes are summed within a range and over the ranges before it, and no task holds a source. Sources may be any number:
their places in order, weights and targets are computed in a table of them, and only sums of it go to the driver.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, materialise, sums_before, without

WEIGHTS, SHARE, MOST_EPOCHS = (3, 1, 2), 1.5, 2.0
#: Rows of a range, about; up to so many sources (of about 100 bytes) are sent to every task, more are joined.
RANGE_ROWS, BROADCAST = 1_000, 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """totals (source, n) with each source's target: weights repeat over the sources by code point, null last; they share out share of all
    sizes; a target stops at most times its source's size, and the excess goes to the others by weight until none is above."""
    order = F.col("source").asc_nulls_last()
    ranged = materialise(totals.repartitionByRange(order).select("*", F.spark_partition_id().cast("long").alias("__part"), F.lit(0).alias("__one")), "sources")
    before = sums_before(ranged.groupBy("__one", "__part").agg(F.count("*").alias("__rows")), ["__one"], "__part", "__rows", "__before").select("__part", "__before")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    placed = materialise(ranged.join(before, "__part").withColumn("__weight", weight).withColumn("__room", F.col("n") * F.lit(float(most))).drop("__part", "__one", "__before"), "weights")
    whole, unit = share * (placed.agg(F.sum("n")).first()[0] or 0), 0.0
    while True:  # a source once full stays full, as the unit only grows
        full = F.lit(unit) * F.col("__weight") > F.col("__room")
        used, open_ = placed.agg(F.sum(F.when(full, F.col("__room"))), F.sum(F.when(~full, F.col("__weight")))).first()
        new = (whole - (used or 0.0)) / open_ if open_ else unit
        if new <= unit:
            break
        unit = new
    return placed.select("source", "n", *without(totals, ["source", "n"]), F.least(F.lit(unit) * F.col("__weight"), F.col("__room")).cast("double").alias("target"))


def mix(df: DataFrame, source: Column, size: Column, identity: list[Column], weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """df with size, source_size, target, start (of the row in its source's order, in words) and taken (words, repeats counted).

    identity makes the random key: an md5 of seed and these columns as text. A source is gone through in the order of the key, as
    often as its target needs; the row at the cut gives as many words as are left, so a source's taken words are its target,
    rounded down. Rows alike in identity, and null sources (one source), are fine; size 0 takes 0. Empty table: no rows. df's rows are
    read three times and shuffled once.
    """
    names = ("size", "source_size", "target", "start", "taken")
    keep = without(df, names)
    key = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))  # never null, so that ranges and their sums meet in the window's own partitions
    rows = df.select(*keep, key.alias("__key"), size.alias("size"), F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in identity))).alias("__random"))
    totals = df.select(source.cast("string").alias("source"), size.alias("n")).groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    goals = materialise(targets(totals, weights, share, most).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("__key"), F.col("n").alias("source_size"), "target", F.ceil(F.col("rows") / RANGE_ROWS).cast("double").alias("__ranges")), "targets")
    sent = F.broadcast(goals) if goals.count() <= BROADCAST else goals
    share_of = F.conv(F.substring("__random", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = rows.join(sent, "__key").withColumn("__range", F.floor(share_of * F.col("__ranges")).cast("long"))
    before = sums_before(rows.groupBy("__key", "__range").agg(F.sum("size").alias("__n")), ["__key"], "__range", "__n", "__before").drop("__n")
    window = Window.partitionBy("__key", "__range").orderBy("__random", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__in", F.sum("size").over(window) - F.col("size")).join(before, ["__key", "__range"]).withColumn("start", F.col("__before") + F.col("__in"))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("start")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.withColumn("taken", taken.cast("long")).select(*keep, *names)


def whole_copies(mixed: DataFrame) -> Column:
    """How often a row of mix() goes into a mix of whole documents: each epoch in which its first half is within the budget."""
    n, size = F.col("source_size"), F.col("size")
    epochs = F.when(n > 0, F.floor((F.col("target") - F.col("start") - size / 2) / n) + 1).otherwise(1)
    return F.greatest(F.lit(0), epochs).cast("int")


def mix_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of documents, sizes in words; a null text has none."""
    narrow = documents.select("doc_id", F.col("source").alias("source"), words(F.col("text")).alias("__size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("__md5"))
    narrow = materialise(narrow, "sized")
    return mix(narrow, F.col("source"), F.col("__size"), [F.col("doc_id"), F.col("__md5")]).select("doc_id", "size", "source_size", "target", "taken")
