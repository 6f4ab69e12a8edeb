"""Prompts as Column expressions; the wording is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUESTION = 'Write %d questions of your own, each in one of these categories: %s. Reply with JSON: [{"category": "...", "question": "..."}]'
ANSWER = "Answer this question clearly and briefly.\n\n%s"
GRADE = 'Grade each response to the question from 1 to 10 for being right, complete and clear.\n\nQuestion: %s\n\n%s\n\nReply with JSON: {"<label>": {"score": <1-10>, "reason": "...", "flags": []}}'
MATH = "Solve the problem step by step and end with the line #### <number>.\n\n%s"
CHOICE = "Pick the right choice and reply with its letter only.\n\n%s\n\n%s"

MATH_GRADE = 'Check each solution of the problem and grade it from 1 to 10: right answers with sound steps highest, right answers with flawed steps lower, wrong ones by what they got right.\n\nQuestion: %s\n\n%s\n\nReply with JSON: {"<label>": {"score": <1-10>, "reason": "..."}}'
CHOICE_GRADE = 'Work out the right choice yourself, then grade each response from 1 to 10 for its choice and its reasons.\n\nQuestion: %s\n\nChoices:\n%s\n\n%s\n\nReply with JSON: {"<label>": {"score": <1-10>, "reason": "..."}}'
ANALYSIS = "Below is a report on models that graded each other. Write an analysis with figures from it: the ranking, the best models, outliers and biases, patterns in speed, cost and categories, doubts, which model to use for what, and five headlines.\n\n%s"


def question_prompt(n: int, categories: Column) -> Column:
    return F.format_string(QUESTION, F.lit(n), F.array_join(categories, ", "))


def answer_prompt(question: Column, grounding: Column | None = None) -> Column:
    """The question, after what a search found if anything."""
    base = F.format_string(ANSWER, question)
    return base if grounding is None else grounded(base, grounding)


def grounded(prompt: Column, grounding: Column) -> Column:
    return F.when(F.coalesce(grounding, F.lit("")) == "", prompt).otherwise(F.concat(F.lit("Recent sources:\n"), grounding, F.lit("\n\n"), prompt))


def responses_block(labelled: Column) -> Column:
    """An array of (label, text) as labelled blocks."""
    return F.array_join(F.transform(labelled, lambda r: F.concat(F.lit("--- "), r["label"], F.lit(" ---\n"), r["text"])), "\n\n")


def grading_prompt(question: Column, labelled: Column) -> Column:
    return F.format_string(GRADE, question, responses_block(labelled))


def math_grading_prompt(question: Column, labelled: Column) -> Column:
    return F.format_string(MATH_GRADE, question, responses_block(labelled))


def choice_grading_prompt(question: Column, choices: Column, labelled: Column) -> Column:
    return F.format_string(CHOICE_GRADE, question, choices_block(choices), responses_block(labelled))


def choice_prompt(question: Column, choices: Column) -> Column:
    return F.format_string(CHOICE, question, choices_block(choices))


def analysis_prompt(report: Column) -> Column:
    return F.format_string(ANALYSIS, report)


def choices_block(choices: Column) -> Column:
    """Lines "A. first", "B. second" and so on."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c)), "\n")
