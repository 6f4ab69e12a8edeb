"""Agreement between judges: correlation over the cells that two judges share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson
from .scores import BASE, rank_by

LEAST_COMMON = 3


def pairs(cube: DataFrame, mode: str = BASE, diagonal: bool = False) -> DataFrame:
    """judge1, judge2, n, r over common (question, model) cells, self-scores included; 0 for fewer than three.

    An equi-join on the cell: each cell meets as many rows as it has judges.
    """
    c = cube.where(F.col("mode") == mode)
    a = c.select("question", "model", F.col("evaluator").alias("judge1"), F.col("evaluator_ord").alias("o1"), F.col("score").alias("x"))
    b = c.select("question", "model", F.col("evaluator").alias("judge2"), F.col("evaluator_ord").alias("o2"), F.col("score").alias("y"))
    order = F.col("o1") <= F.col("o2") if diagonal else F.col("o1") < F.col("o2")
    j = a.join(b, ["question", "model"]).where(order)
    return j.groupBy("judge1", "o1", "judge2", "o2").agg(F.count("*").alias("n"), F.round(pearson("x", "y", LEAST_COMMON), 6).alias("r"))


def matrix(cube: DataFrame, mode: str = BASE) -> DataFrame:
    """Both halves and the diagonal."""
    p = pairs(cube, mode, diagonal=True)
    return p.select("judge1", "judge2", "r").unionByName(p.where("o1 < o2").select(F.col("judge2").alias("judge1"), F.col("judge1").alias("judge2"), "r"))


def extremes(cube: DataFrame, n: int = 3) -> DataFrame:
    """The n most and the n least similar pairs."""
    p = pairs(cube).withColumn("top", rank_by(F.desc("r"), F.col("o1"), F.col("o2"))).withColumn("bottom", rank_by(F.asc("r"), F.desc("o1"), F.desc("o2")))
    return p.where((F.col("top") <= n) | (F.col("bottom") <= n)).select("judge1", "judge2", "r", F.when(F.col("top") <= n, "most").otherwise("least").alias("side"))


def mean_agreement(cube: DataFrame) -> DataFrame:
    return pairs(cube).agg(F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 6).alias("mean_r"), F.count("*").alias("pairs"))
