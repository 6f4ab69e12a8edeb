"""Peer, self and raw scores, judge generosity and the bias family over the score cube.

The cube has a row a cell: mode, evaluator, question, model, score, with the ordinals of each. Peer cells are those of
another evaluator. Each view is one grouped pass with conditional aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE, NAMES, PLACES = "shuffle_blind", "shuffle_only", "blind_only"


def is_peer() -> Column:
    return F.col("evaluator") != F.col("model")


def rank_by(*order: Column) -> Column:
    """Position from 1; the caller breaks ties by an ordinal."""
    return F.row_number().over(Window.orderBy(*order)).cast("long")


def peer_cells(cube: DataFrame, mode: str = BASE) -> DataFrame:
    return cube.where((F.col("mode") == mode) & is_peer())


def peer_stats(cube: DataFrame, mode: str = BASE) -> DataFrame:
    """Models with a peer score: mean, deviation (0 of one score), number, self mean (0 of none), self less peer, raw mean."""
    peer, own = F.when(is_peer(), F.col("score")), F.when(~is_peer(), F.col("score"))
    g = cube.where(F.col("mode") == mode).groupBy("model", "model_ord")
    s = g.agg(F.avg(peer).alias("peer"), F.coalesce(F.stddev_samp(peer), F.lit(0.0)).alias("sd"), F.count(peer).alias("n"), F.coalesce(F.avg(own), F.lit(0.0)).alias("self"), F.count(own).alias("n_self"), F.avg("score").alias("raw"))
    return s.where("n > 0").withColumn("self_minus_peer", F.col("self") - F.col("peer"))


def peer_rankings(cube: DataFrame, mode: str = BASE) -> DataFrame:
    s = peer_stats(cube, mode)
    return s.select(rank_by(F.desc("peer"), F.col("model_ord")).alias("rank"), "model", *[F.round(c, 4).alias(c) for c in ("peer", "sd", "self", "self_minus_peer", "raw")], "n")


def self_bias(cube: DataFrame, mode: str = BASE, missing: str = "zero") -> DataFrame:
    """Self mean less peer mean. A model that never grades itself has the self mean 0, the bias 0, or null, as missing says: zero, neutral, null."""
    s = peer_stats(cube, mode)
    absent = {"zero": F.col("self_minus_peer"), "neutral": F.lit(0.0), "null": F.lit(None).cast("double")}[missing]
    return s.select("model", "n_self", F.round(F.when(F.col("n_self") > 0, F.col("self_minus_peer")).otherwise(absent), 4).alias("self_bias"))


def judge_generosity(cube: DataFrame, mode: str = BASE) -> DataFrame:
    g = peer_cells(cube, mode).groupBy("evaluator", "evaluator_ord").agg(F.avg("score").alias("given"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.stddev_pop("score").alias("sd_pop"), F.count("*").alias("n"))
    return g.select(rank_by(F.desc("given"), F.col("evaluator_ord")).alias("rank"), "evaluator", *[F.round(c, 4).alias(c) for c in ("given", "sd", "sd_pop")], "n")


def of_roster(rows: DataFrame, roster: DataFrame, column: str = "model") -> DataFrame:
    """The rows whose model is of the roster (column model)."""
    return rows.join(roster.select(F.col("model").alias(column)).distinct(), column, "left_semi")


def peer_rows(cube: DataFrame, samples: DataFrame) -> DataFrame:
    """Rank, peer mean and deviation, number of scores, mean answer time, self mean (0 if none), self bias and raw mean; models with a peer score.

    samples: model, seconds; calls that took no time failed and do not count, a model without others has a time of 0.
    """
    t = samples.groupBy("model").agg(F.coalesce(F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))), F.lit(0.0)).alias("seconds"))
    return peer_rankings(cube).join(t, "model", "left").withColumn("seconds", F.round(F.coalesce("seconds", F.lit(0.0)), 4))


def mode_stats(cube: DataFrame) -> DataFrame:
    """Of each mode and model: mean, deviation (n), standard error (n - 1) and number of peer and of self scores."""
    out = []
    for name, x in (("peer", F.when(is_peer(), F.col("score"))), ("self", F.when(~is_peer(), F.col("score")))):
        n = F.count(x)
        out += [F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_sd"), F.when(n > 1, F.stddev_samp(x) / F.sqrt(n)).otherwise(0.0).alias(f"{name}_se"), n.alias(f"{name}_n")]
    return cube.groupBy("mode", "model", "model_ord").agg(*out)


def bias_analysis(cube: DataFrame, roster: DataFrame) -> DataFrame:
    """The three mode means of each model of the roster (0 without scores) and the name and position bias against the baseline; no rows unless all modes are there."""
    modes = cube.select("mode").where(F.col("mode").isin(BASE, NAMES, PLACES)).distinct().agg(F.count("*").alias("modes"))
    mean = lambda m: F.coalesce(F.avg(F.when((F.col("mode") == m) & is_peer(), F.col("score"))), F.lit(0.0))
    g = cube.groupBy("model").agg(mean(BASE).alias("base"), mean(NAMES).alias("names"), mean(PLACES).alias("places"))
    r = roster.join(g, "model", "left").na.fill(0.0, ["base", "names", "places"])
    r = r.withColumn("name_bias", F.col("names") - F.col("base")).withColumn("position_bias", F.col("places") - F.col("base"))
    return r.withColumn("one", F.lit(1)).join(F.broadcast(modes.where("modes = 3").select(F.lit(1).alias("one"))), "one").drop("one")


def biases_with_errors(cube: DataFrame) -> DataFrame:
    """Name and self bias with combined standard errors and 95 % bars."""
    s = mode_stats(cube)
    pick = lambda m, *cs: s.where(F.col("mode") == m).select("model", *[F.col(c).alias(f"{c}_{m}") for c in cs])
    j = pick(BASE, "peer_mean", "peer_se", "self_mean", "self_se").join(pick(NAMES, "peer_mean", "peer_se"), "model")
    c = lambda name, m: F.col(f"{name}_{m}")
    name_se, self_se = F.sqrt(c("peer_se", BASE) ** 2 + c("peer_se", NAMES) ** 2), F.sqrt(c("peer_se", BASE) ** 2 + c("self_se", BASE) ** 2)
    values = {"name_bias": c("peer_mean", NAMES) - c("peer_mean", BASE), "name_ci95": 1.96 * name_se, "self_bias": c("self_mean", BASE) - c("peer_mean", BASE), "self_ci95": 1.96 * self_se}
    return j.select("model", *[F.round(v, 4).alias(k) for k, v in values.items()])


def position_bias(cube: DataFrame) -> DataFrame:
    """Of each roster position: the mean under fixed order, the baseline, their difference and its standard error."""
    s = mode_stats(cube)
    a = s.where(F.col("mode") == PLACES).select("model", (F.col("model_ord") + 1).alias("position"), F.col("peer_mean").alias("blind"), F.col("peer_se").alias("s1"), F.col("peer_n").alias("n_blind"))
    b = s.where(F.col("mode") == BASE).select("model", F.col("peer_mean").alias("peer"), F.col("peer_se").alias("s2"), F.col("peer_n").alias("n_peer"))
    return a.join(b, "model").select("position", "model", F.round("blind", 4).alias("blind"), F.round("peer", 4).alias("peer"), F.round(F.col("blind") - F.col("peer"), 4).alias("bias"), F.round(F.sqrt(F.col("s1") ** 2 + F.col("s2") ** 2), 4).alias("se"), "n_blind", "n_peer")


def self_bias_by_mode(cube: DataFrame) -> DataFrame:
    s = mode_stats(cube).where("self_n > 0 AND peer_n > 0")
    return s.groupBy("mode").agg(F.round(F.avg(F.col("self_mean") - F.col("peer_mean")), 4).alias("self_bias"), F.count("*").alias("models"))


def cross_matrix(cube: DataFrame, mode: str = BASE) -> DataFrame:
    """Mean score of each evaluator for each model, itself included."""
    return cube.where(F.col("mode") == mode).groupBy("evaluator", "model").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"))


def category_rankings(cube: DataFrame, questions: DataFrame, roster: DataFrame, mode: str = BASE) -> DataFrame:
    """Rank and mean of every roster model in each category and overall; 0 without scores."""
    cells = peer_cells(cube, mode).join(questions.select("question", "category"), "question", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    means = cells.groupingSets([("model", "category"), ("model",)], "model", "category").agg(F.avg("score").alias("score"), F.grouping("category").alias("g"))
    means = means.select("model", F.when(F.col("g") == 1, "overall").otherwise(F.col("category")).alias("category"), "score")
    every = roster.select("model", "model_ord").join(F.broadcast(means.select("category").distinct()), how="cross")  # two small dimensions
    full = every.join(means, ["model", "category"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "model_ord")).cast("long")
    return full.select("category", "model", rank.alias("rank"), F.round("score", 4).alias("score"))


def coverage(questions: DataFrame) -> DataFrame:
    """Questions by source and category with row, column and grand totals."""
    c = questions.cube("source_model", "category").agg(F.count("*").alias("n"), F.grouping("source_model").alias("a"), F.grouping("category").alias("b"))
    return c.select(F.when(F.col("a") == 1, "TOTAL").otherwise(F.col("source_model")).alias("source_model"), F.when(F.col("b") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "n")
