"""Conversations and answers: where a summary may cut, tool results' caps, outcomes of checked answers, changes between runs, scores by position."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.fixed import CAPS, KEEP_MESSAGES, OTHER_CAP, SUMMARY_TOKENS


def split_points(messages: DataFrame, conversation: str, order: str, keep: int = KEEP_MESSAGES, tokens: int = SUMMARY_TOKENS) -> DataFrame:
    """(conversation, messages, est_tokens, split) of (conversation, order, role, text): the first split messages may be summarised; null where none are.

    The last keep stay; a result of a tool never parts from the call before it, so the cut moves left over results. No summary for keep + 2
    messages or fewer, nor below so many estimated tokens.
    """
    placed = messages.select(conversation, "role", F.length("text").alias("n"), (F.row_number().over(Window.partitionBy(conversation).orderBy(order)) - 1).alias("at"))
    total = placed.groupBy(conversation).agg(F.count("*").alias("messages"), F.floor(F.coalesce(F.sum("n"), F.lit(0)) / 4).alias("est_tokens"))
    cut = placed.where("role <> 'tool'").join(total, conversation).where(F.col("at") <= F.col("messages") - keep).groupBy(conversation).agg(F.max("at").alias("split"))
    due = (F.col("messages") > keep + 2) & (F.col("est_tokens") >= tokens) & (F.col("split") > 0)
    return total.join(cut, conversation, "left").select(conversation, "messages", "est_tokens", F.when(due, F.col("split")).cast("long").alias("split"))


def capped(result: Column, tool: Column) -> Column:
    """A tool's result cut to its cap, and how much is gone; a tool without a cap of its own has the common one."""
    most = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in CAPS.items() for x in pair)), tool), F.lit(OTHER_CAP))
    cut = F.concat(F.substring(result, F.lit(1), most), F.lit("\n[... "), (F.length(result) - most).cast("string"), F.lit(" characters truncated ...]"))
    return F.when(F.length(result) <= most, result).otherwise(cut)


def answer_outcome(has_evidence: Column, error: Column, refused: Column, cited: Column, expected: Column) -> Column:
    """The first that holds: REFUSED_BY_FLOOR, ERROR, REFUSED_BY_MODEL, NO_CITATION, CITED_EXPECTED (an expected source is part of a cited one), CITED_WRONG."""
    right = F.exists(cited, lambda c: F.exists(expected, lambda e: F.contains(c, e)))
    return F.when(~has_evidence, "REFUSED_BY_FLOOR").when(error.isNotNull(), "ERROR").when(refused, "REFUSED_BY_MODEL").when(F.size(cited) == 0, "NO_CITATION").when(right, "CITED_EXPECTED").otherwise("CITED_WRONG")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, change) of two runs (key, refused) by question: now answers, now refuses, same; missing where one run lacks it."""
    both = before.select(key, F.col("refused").alias("before")).join(after.select(key, F.col("refused").alias("after")), key, "full")
    change = F.when(F.col("before").isNull() | F.col("after").isNull(), "missing").when(F.col("before") & ~F.col("after"), "now answers").when(~F.col("before") & F.col("after"), "now refuses").otherwise("same")
    return both.withColumn("change", change)


def scored(candidates: DataFrame, scores: DataFrame, order: str) -> DataFrame:
    """candidates with the score of their place, counted from 1 by order; a score that is no number from 0 to 1, or for no place, is null. Of scores (index, score) for one place the greatest holds. A stated list of a search's results."""
    value = F.col("score").try_cast("double")
    sound = scores.select("index", F.when(value.between(0, 1), value).alias("score")).groupBy("index").agg(F.max("score").alias("score"))
    return candidates.withColumn("index", F.row_number().over(Window.orderBy(order))).join(F.broadcast(sound), "index", "left")


def last_wins(pairs: Column) -> Column:
    """Of an array of (key, value): each key once, where it stood first, with its last value."""
    return F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def clamped(value: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), value))


def refusal_reason(best: Column, floor: float) -> Column:
    """Why nothing is answered, to three decimals."""
    shown = F.format_string("Best match %.3f is below the evidence floor %.3f.", best, F.lit(float(floor)))
    return F.when(best.isNull(), "Nothing was found.").when(best < floor, shown)
