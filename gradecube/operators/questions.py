"""Statistics of questions, and the hardest, easiest, most disputed and most agreed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scores import BASE


def question_stats(cube: DataFrame, mode: str = BASE) -> DataFrame:
    """Mean, deviation (0 of one), least, most and number of all scores of a question, self-scores included."""
    g = cube.where(F.col("mode") == mode).groupBy("question", "q_ord")
    return g.agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("n"))


def best_and_worst(cube: DataFrame, mode: str = BASE) -> DataFrame:
    """The models with the best and the worst mean of each question; the first in roster order wins ties."""
    m = cube.where(F.col("mode") == mode).groupBy("question", "q_ord", "model", "model_ord").agg(F.avg("score").alias("a"))
    return m.groupBy("question", "q_ord").agg(F.max_by("model", F.struct("a", -F.col("model_ord"))).alias("best"), F.min_by("model", F.struct("a", "model_ord")).alias("worst"))


def top(stats: DataFrame, by: str, highest: bool, n: int = 5) -> DataFrame:
    """The n first questions by a statistic. Ties go by order of appearance when the list is read from its front, against it from its back."""
    front = {("mean", False): True, ("mean", True): False, ("sd", True): True, ("sd", False): False}[by, highest]
    order = [F.desc(by) if highest else F.asc(by), F.asc("q_ord") if front else F.desc("q_ord")]
    t = stats.orderBy(*order).limit(n)
    return t.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "question", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def medians(stats: DataFrame) -> DataFrame:
    return stats.agg(F.round(F.median("mean"), 4).alias("median_mean"), F.round(F.median("sd"), 4).alias("median_sd"))


def autopsy_rows(asked: DataFrame) -> DataFrame:
    """source_model, category, question and id, its first fifty characters, of questions as json_files reads them."""
    return asked.select("source_model", "category", "question", F.substring("question", 1, 50).alias("id"))
