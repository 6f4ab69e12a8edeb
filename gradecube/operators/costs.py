"""Timing, cost, efficiency, refusals and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import safe
from ..functions.text import estimated_tokens
from .scores import rank_by

EXPONENT = 2.0
#: Price of one search, in dollars.
SEARCH_PRICES = {"tavily": 0.008, "serpapi": 0.01}


def timing(samples: DataFrame) -> DataFrame:
    """Total, mean of successes (0 without), attempts and successes of each model; 0 seconds is a failure."""
    ok = F.when(F.col("seconds") > 0, F.col("seconds"))
    return samples.groupBy("model").agg(F.round(F.sum("seconds"), 2).alias("total"), F.round(F.coalesce(F.avg(ok), F.lit(0.0)), 2).alias("mean"), F.count("*").alias("n"), F.count(ok).alias("ok"))


def failed(samples: DataFrame) -> DataFrame:
    return timing(samples).where("ok = 0 AND n > 0").select("model", "n")


def refused(answers: DataFrame) -> DataFrame:
    """Refusals: answers without an error and without text."""
    return answers.where(F.trim("text") == "")


def costs(answers: DataFrame, models: DataFrame) -> DataFrame:
    """Each answer's cost by its model's prices a million tokens; unknown models cost nothing."""
    p = F.broadcast(models.select(F.col("ordinal").alias("model_ord"), "in_per_m", "out_per_m"))
    cost = F.coalesce((F.col("in_tok") * F.col("in_per_m") + F.col("out_tok") * F.col("out_per_m")) / 1e6, F.lit(0.0))
    return answers.join(p, "model_ord", "left").withColumn("cost", cost)


def cost_table(answers: DataFrame, models: DataFrame) -> DataFrame:
    g = costs(answers, models).groupBy("model", "model_ord").agg(F.sum("cost").alias("c"), F.count("*").alias("calls"), F.sum("in_tok").alias("in_tok"), F.sum("out_tok").alias("out_tok"))
    return g.select(rank_by(F.desc(F.round("c", 4)), F.col("model_ord")).alias("rank"), "model", F.round("c", 4).alias("cost"), "calls", "in_tok", "out_tok", F.round(F.col("c") / F.col("calls"), 6).alias("per_call"))


def cost_rollup(answers: DataFrame, models: DataFrame) -> DataFrame:
    g = costs(answers, models).rollup("model").agg(F.round(F.sum("cost"), 4).alias("cost"), F.count("*").alias("calls"), F.grouping("model").alias("g"))
    return g.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("model")).alias("model"), "cost", "calls")


def efficiency(peer: DataFrame, answers: DataFrame, models: DataFrame, exponent: float = EXPONENT) -> DataFrame:
    """Peer mean to the exponent over the mean cost in cents, 0 if free; ranked by the rounded value."""
    c = costs(answers, models).groupBy("model", "model_ord").agg(F.avg("cost").alias("c"))
    value = F.coalesce(safe(F.pow("peer", F.lit(exponent)), F.col("c") * 100), F.lit(0.0))
    j = peer.select("model", "peer").join(c, "model").withColumn("efficiency", F.round(value, 2))
    return j.select(rank_by(F.desc("efficiency"), F.col("model_ord")).alias("rank"), "model", F.round("peer", 4).alias("peer"), F.round(F.col("c") * 100, 4).alias("cents"), "efficiency")


def estimated_input(answers: DataFrame, questions: DataFrame, web: Column | bool = False) -> DataFrame:
    """Mean estimated input tokens over the questions a model answered: a quarter of the characters, 50, and 2000 with a search.

    web: whether there was a search, for the run or, as a column of answers, for each answer.
    """
    q = questions.select("q_ord", "question")
    tokens = estimated_tokens(F.col("question")) + 50 + F.col("_search")
    search = F.when(web if isinstance(web, Column) else F.lit(web), 2000).otherwise(0)
    return answers.withColumn("_search", search).where(F.trim("text") != "").join(q, "q_ord").groupBy("model").agg(F.floor(F.avg(tokens)).cast("long").alias("tokens"))


def searches(log: DataFrame, provider: str = "tavily") -> DataFrame:
    asked = ~F.coalesce(F.col("skipped"), F.lit(False))
    g = log.agg(F.count("*").alias("total"), F.count_if(asked).alias("attempted"), F.count_if(F.col("success").eqNullSafe(True)).alias("successful"), F.count_if(F.col("success").eqNullSafe(False)).alias("failed"), F.count_if(~asked).alias("skipped"), F.round(F.sum("duration"), 2).alias("seconds"))
    return g.withColumn("cost", F.round(F.col("attempted") * SEARCH_PRICES[provider], 4))
