"""Explicit schemas of the files that runs leave."""

from __future__ import annotations

ANSWER = "STRUCT<text: STRING, in_tok: BIGINT, out_tok: BIGINT, llm_cost: DOUBLE, cost: DOUBLE, refused: BOOLEAN>"
QUESTIONS = "revision STRING, timestamp STRING, questions_by_model MAP<STRING, ARRAY<STRUCT<category: STRING, question: STRING>>>, timing_by_model MAP<STRING, DOUBLE>"
ANSWERS = f"revision STRING, timestamp STRING, questions ARRAY<STRUCT<source: STRING, category: STRING, text: STRING, answers: MAP<STRING, {ANSWER}>>>"
#: The innermost value is the raw JSON of a judge's scores of one question, so that odd cells survive until a policy is chosen.
EVALUATIONS = "revision STRING, timestamp STRING, complete BOOLEAN, evaluations_by_mode MAP<STRING, MAP<STRING, MAP<STRING, STRING>>>"
GROUNDING = "revision STRING, provider STRING, grounding ARRAY<STRUCT<index: INT, question: STRING, category: STRING, source: STRING, duration: DOUBLE, success: BOOLEAN, grounding: STRING, skipped: BOOLEAN>>"
MODELS = "provider STRING, model_id STRING, name STRING, cost STRUCT<in_per_m: DOUBLE, out_per_m: DOUBLE>, active BOOLEAN"
MATH_TRUTH = "questions ARRAY<STRUCT<question: STRING, solution: STRING, gold_answer: DOUBLE, difficulty: STRING, steps: INT>>"
CHOICE_TRUTH = "questions ARRAY<STRUCT<question: STRING, choices: ARRAY<STRING>, answer: INT, subject: STRING>>"
TRUTHFUL_TRUTH = "questions ARRAY<STRUCT<category: STRING, question: STRING, choices: ARRAY<STRING>, correct_index: INT>>"
