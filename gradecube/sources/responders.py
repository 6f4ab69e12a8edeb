"""Models and searches behind one interface; a real one calls a service, the one here makes its replies up.

A responder is made once in each Python worker and answers a batch of prompts. Retries belong to it, not to the plan.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NEVER_RETRY, RETRY
from ..operators.catalog import reasoning_label

Responder = Callable[[str, str], tuple[str, int, int]]
MOST_TRIES, FIRST_WAIT = 5, 4.0


def made_up(model: str, prompt: str) -> tuple[str, int, int]:
    """A reply that depends on model and prompt alone."""
    x = int(hashlib.md5(f"{model}|{prompt}".encode()).hexdigest(), 16)
    text = f"The answer is {x % 100}."
    return text, len(prompt) // 4, len(text) // 4


def retried(call: Responder, model: str, prompt: str, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, int]:
    """call, tried again after 4, 8, 16 ... seconds on errors that may pass."""
    for attempt in range(MOST_TRIES):
        try:
            return call(model, prompt)
        except Exception as e:
            said = str(e).lower()
            last = attempt + 1 == MOST_TRIES or any(x in said for x in NEVER_RETRY) or not any(x in said for x in RETRY)
            if last:
                raise
            sleep(FIRST_WAIT * 2**attempt)
    raise AssertionError


def respond(prompts: DataFrame, make: Callable[[], Responder] = lambda: made_up) -> DataFrame:
    """prompts (model, prompt) with text, in_tok, out_tok, seconds and error; a failed call gives a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for b in batches:
            out = []
            for model, prompt in zip(b.column("model").to_pylist(), b.column("prompt").to_pylist(), strict=True):
                began = time.time()
                try:
                    text, i, o = retried(call, model, prompt)
                    out.append((model, prompt, text, i, o, time.time() - began, None))
                except Exception as e:  # the error is the row's result
                    out.append((model, prompt, None, 0, 0, time.time() - began, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()))], names=["model", "prompt", "text", "in_tok", "out_tok", "seconds", "error"])

    return prompts.select("model", "prompt").mapInArrow(run, "model string, prompt string, text string, in_tok long, out_tok long, seconds double, error string")


def health(models: DataFrame, make: Callable[[], Responder] = lambda: made_up) -> DataFrame:
    """model, healthy, seconds, error, reasoning of models (name, provider, model_id), each asked once."""
    label = reasoning_label(F.col("provider"), F.col("model_id"))
    asked = respond(models.select(F.col("name").alias("model"), F.lit("Reply with OK.").alias("prompt")), make)
    said = asked.select("model", (F.col("error").isNull() & (F.trim("text") != "")).alias("healthy"), "seconds", "error")
    return said.join(models.select(F.col("name").alias("model"), label.alias("reasoning")), "model")


def searched(questions: DataFrame, make: Callable[[], Responder], most: int = 250) -> DataFrame:
    """question, grounding, success, seconds: what a search engine (a responder) says of each question; failures leave no text.

    questions hold one row a question; most is the length of what each line of a reply keeps.
    """
    found = respond(questions.select(F.lit("search").alias("model"), F.col("question").alias("prompt")), make)
    kept = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.left(x, F.lit(most))), "\n")
    return found.select(F.col("prompt").alias("question"), F.coalesce(kept, F.lit("")).alias("grounding"), (F.col("error").isNull() & (F.trim("text") != "")).alias("success"), "seconds")
