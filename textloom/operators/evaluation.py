"""Evaluation sets against the live articles."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drift(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, title, question_id, actual, problem): claims (question_id, article_id, title) that articles (id, title) don't bear out.

    problem is gone or retitled; titles are compared without outer blanks. Each claimed title of an article comes once, under its least question.
    """
    once = claims.groupBy("article_id", "title").agg(F.min("question_id").alias("question_id"))
    live = articles.select(F.col("id").alias("article_id"), F.col("title").alias("actual"), F.lit(True).alias("__live"))
    problem = F.when(F.col("__live").isNull(), "gone").when(~F.trim("actual").eqNullSafe(F.trim("title")), "retitled")
    return once.join(live, "article_id", "left").withColumn("problem", problem).where("problem is not null").drop("__live")
