"""Public benchmarks with known answers, from their exported tables (Parquet or JSON with the publisher's columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog


def math_problems(rows: DataFrame) -> DataFrame:
    """question, solution, gold_num, steps, difficulty of rows (question, answer)."""
    steps = text.solution_steps(F.col("solution"))
    s = rows.select("question", F.col("answer").alias("solution"))
    return s.select("*", text.gold_answer(F.col("solution")).alias("gold_num"), steps.alias("steps"), text.difficulty(steps).alias("difficulty"))


def subject_questions(rows: DataFrame, subjects: list[str] | None = None) -> DataFrame:
    """question, subject ("unknown" if missing), choices, answer of rows whose subject is asked for, or of all."""
    s = rows.select("question", F.coalesce("subject", F.lit("unknown")).alias("subject"), "choices", "answer")
    return s.where(F.col("subject").isin(subjects)) if subjects else s


def truthful_questions(choices: DataFrame, categories: DataFrame) -> DataFrame:
    """question, category, choices, correct_index: rows (question, choices, labels) with a right answer.

    categories (question, category) names each question's own category, the last in reading order of a question that repeats;
    without one, or with an unknown one, the default category stands.
    """
    last = categories.withColumn("k", F.monotonically_increasing_id()).groupBy("question").agg(F.max_by("category", "k").alias("own"))
    j = catalog.valid_choices(choices.select("question", "choices", "labels")).join(last, "question", "left")
    return j.select("question", catalog.mapped_category(F.coalesce("own", F.lit(""))).alias("category"), "choices", "correct_index")
