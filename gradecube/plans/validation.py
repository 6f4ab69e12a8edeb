"""Phases of a validation against multiple choice, put together from those of phases.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import choice_letter, letter_cascade
from ..operators.sampling import shuffled_choices
from ..sources.providers import Client
from . import phases

#: Characters of an answer that a judge is shown.
SHOWN = 500
LETTERS = {"first": choice_letter, "cascade": letter_cascade}


def choice_questions(rows: DataFrame, shuffle: bool = True) -> DataFrame:
    """question_id, question, choices, letter, prompt of rows (question_id, question, choices and, unless shuffled, correct_index).

    Shuffled, the first choice is the right one and goes where the md5 order puts it; else the index tells which is.
    """
    order, letter = shuffled_choices(F.col("choices"), F.col("question_id")) if shuffle else (F.col("choices"), F.char(F.lit(65) + F.col("correct_index")))
    q = rows.select("question_id", "question", order.alias("choices"), letter.alias("letter"))
    return q.withColumn("prompt", prompts.choice_prompt(F.col("question"), F.col("choices")))


def choice_answers(questions: DataFrame, models: DataFrame, path: str, revision: str, connect: Callable[[str], Client], letters: str = "first", **how) -> DataFrame:
    """The committed answers with the letter each means and whether it is right; a failed call or no letter is wrong.

    letters: the rule that finds a letter, the first one there is or the cascade of likelier places.
    """
    given = phases.answers(questions.select("question_id", "prompt"), models, path, revision, connect, **how)
    meant = F.when(F.col("error").isNull(), LETTERS[letters](F.col("text"))).otherwise("?")
    j = given.join(questions.select("question_id", "letter"), "question_id").withColumn("meant", meant)
    return j.withColumn("correct", F.col("meant") == F.col("letter"))


def accuracy(answers: DataFrame) -> DataFrame:
    """model, correct, total, accuracy (percent) and mean (of ten) of choice_answers()."""
    g = answers.groupBy("model").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    return g.select("model", "correct", "total", F.round(F.col("correct") * 100.0 / F.col("total"), 1).alias("accuracy"), F.round(F.col("correct") * 10.0 / F.col("total"), 2).alias("mean"))


def choice_evaluations(questions: DataFrame, answers: DataFrame, models: DataFrame, path: str, revision: str, connect: Callable[[str], Client], **how) -> DataFrame:
    """The cells of all modes from judges who see question, choices and the answers cut to SHOWN characters; only exact labels count."""
    prompt = lambda rows: prompts.choice_grading_prompt(rows["question"], rows["choices"], rows["labelled"])
    return phases.evaluations(questions, answers, models, path, revision, connect, prompt=prompt, most=SHOWN, exact=True, **how)
