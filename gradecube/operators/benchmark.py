"""Validation of peer scores against benchmarks with known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special, stats
from ..functions.text import model_answer, numbers_match
from .inference import correlation, mid_rank
from .scores import BASE, NAMES, PLACES, mode_stats, peer_cells, peer_stats, rank_by


def graded(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Each answer with its extracted number and whether it is right; questions without a gold answer drop out."""
    g = gold.where(F.col("gold_num").isNotNull()).select("q_ord", "gold_num")
    return answers.join(g, "q_ord").withColumn("extracted", model_answer(F.col("text"))).withColumn("correct", numbers_match(F.col("extracted"), F.col("gold_num")))


def accuracy(rows: DataFrame) -> DataFrame:
    total = F.count("*")
    right = F.count_if("correct")
    g = rows.groupBy("model", "model_ord").agg(right.alias("correct"), total.alias("total"))
    return g.withColumn("accuracy", F.round(F.col("correct") * 100.0 / F.col("total"), 1)).withColumn("mean", F.round(F.col("correct") * 10.0 / F.col("total"), 2))


def accuracy_intervals(acc: DataFrame) -> DataFrame:
    low, high = stats.wilson(F.col("correct"), F.col("total"))
    return acc.select("model", "correct", "total", low.alias("low"), high.alias("high"))


def score_intervals(cube: DataFrame, mode: str = BASE) -> DataFrame:
    """Student intervals of the peer means; a single score stands for both ends."""
    s = peer_stats(cube, mode)
    half = F.when(F.col("n") > 1, special.t_crit(F.greatest(F.col("n") - 1, F.lit(1)).cast("double")) * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return s.select("model", F.round(F.col("peer") - half, 2).alias("low"), F.round(F.col("peer") + half, 2).alias("high"))


def comparison(cube: DataFrame, acc: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Peer and truth scores and ranks of the models that have both; models without a right answer drop out unless kept."""
    p = peer_cells(cube).groupBy("model", "model_ord").agg(F.avg("score").alias("peer"), F.count("*").alias("n"))
    t = acc.where("total > 0" if keep_zero else "mean > 0").select("model", F.col("mean").alias("truth"), "accuracy", "correct", "total")
    j = p.join(t, "model").withColumn("peer_rank", rank_by(F.desc("peer"), F.col("model_ord"))).withColumn("truth_rank", mid_rank(F.col("truth")))
    return j.withColumn("rank_diff", F.col("peer_rank") - F.col("truth_rank"))


def shown(c: DataFrame) -> DataFrame:
    return c.select("model", F.round("peer", 4).alias("peer"), "truth", "peer_rank", F.col("truth_rank").cast("double").alias("truth_rank"), F.col("rank_diff").cast("double").alias("rank_diff"))


def correlated(c: DataFrame) -> DataFrame:
    return correlation(c, "peer", "truth").select("n", "pearson", "spearman", stats.strength(F.col("pearson")).alias("strength"))


def correlated_with_ci(c: DataFrame) -> DataFrame:
    r = correlation(c, "peer", "truth")
    low, high = stats.fisher(F.col("pearson"), F.col("n"))
    return r.select("n", "pearson", low.alias("low"), high.alias("high"))


def correlated_with_p(c: DataFrame) -> DataFrame:
    r = correlation(c, "peer", "truth")
    return r.select("n", "pearson", special.pearson_p("pearson", F.col("n").cast("double")).alias("pearson_p"), "spearman", special.pearson_p("spearman", F.col("n").cast("double")).alias("spearman_p"))


def fit_quality(c: DataFrame) -> DataFrame:
    """The share of the truth's variance that the line on peer scores explains, and what the report concludes from it."""
    r = correlation(c, "peer", "truth").join(c.agg(F.count_distinct("truth").alias("truths")), how="cross")  # one row each
    p = special.pearson_p("pearson", F.col("n").cast("double"))
    return r.select("n", "pearson", F.round(F.col("pearson") * F.col("pearson"), 6).alias("r2"), conclusion(F.col("pearson"), p, F.col("truths")).alias("conclusion"))


def conclusion(r: Column, p: Column, truths: Column) -> Column:
    """What a validation report says of a correlation, its p-value and the number of different accuracies."""
    sure = p < 0.05
    return F.when((r >= 0.7) & sure, "strongly correlates").when((r >= 0.5) & sure, "moderate correlation").when(truths == 1, "cannot determine").otherwise("weak/no correlation")


def misjudged(c: DataFrame) -> DataFrame:
    """The models that peers rank furthest above and below their accuracy."""
    first = lambda sign: F.max_by("model", F.struct(sign * F.col("rank_diff"), -F.col("model_ord")))
    return c.agg(first(-1.0).alias("over_rated"), F.min("rank_diff").cast("double").alias("over_diff"), first(1.0).alias("under_rated"), F.max("rank_diff").cast("double").alias("under_diff"))


def rank_agreement(c: DataFrame) -> DataFrame:
    d = F.abs("rank_diff")
    return c.agg(F.count("*").alias("n"), F.count_if(d < 0.5).alias("exact"), F.count_if(d <= 1.5).alias("within_1"), F.round(F.avg(d), 4).alias("mean_diff"), F.max(d).cast("double").alias("max_diff"), F.round(F.avg("accuracy"), 4).alias("mean_accuracy"), F.round(F.stddev_pop("accuracy"), 4).alias("sd_accuracy"), F.round(F.max("accuracy") - F.min("accuracy"), 4).alias("range_accuracy"))


def ablation(cube: DataFrame, acc: DataFrame, least: int = 3) -> DataFrame:
    """Correlation with truth of peer scores and of self scores, and how much better the former is; no row for fewer than three models."""
    s = peer_stats(cube).where("n_self > 0").select("model", "peer", "self").join(acc.where("mean > 0").select("model", F.col("mean").alias("truth")), "model")
    one = lambda x: correlation(s, x, "truth").select("n", F.col("pearson").alias(f"{x}_r"), F.col("spearman").alias(f"{x}_rho"))
    j = one("peer").join(one("self"), "n").where(F.col("n") >= least).where((F.col("self_r") != 0) | (F.col("self_rho") != 0))
    return j.select("n", "peer_r", "self_r", "peer_rho", "self_rho", F.round(F.col("peer_r") - F.col("self_r"), 6).alias("gain_r"), F.round(F.col("peer_rho") - F.col("self_rho"), 6).alias("gain_rho"))


def ablation_by_model(cube: DataFrame, acc: DataFrame) -> DataFrame:
    """Peer and self mean of each model with a right answer, and its self, name and position bias, null where a mode or its self scores are missing."""
    s = mode_stats(cube)
    mean = lambda mode, name: s.where(F.col("mode") == mode).where(F.col("peer_n") > 0).select("model", F.col("peer_mean").alias(name))
    own = s.where((F.col("mode") == BASE) & (F.col("self_n") > 0)).select("model", F.col("self_mean").alias("self"))
    j = mean(BASE, "peer").join(acc.where("mean > 0").select("model", F.col("mean").alias("truth")), "model").join(own, "model", "left").join(mean(NAMES, "named"), "model", "left").join(mean(PLACES, "placed"), "model", "left")
    less = lambda c, name: F.round(F.col(c) - F.col("peer"), 4).alias(name)
    return j.select("model", F.round("peer", 4).alias("peer"), F.round("self", 4).alias("self"), "truth", less("self", "self_bias"), less("named", "name_bias"), less("placed", "position_bias"))


def reasoning_modes(answers: DataFrame) -> DataFrame:
    """Characters shown for each token paid: few of them tell of hidden reasoning."""
    g = answers.groupBy("model").agg(F.avg("out_tok").alias("t"), F.avg(F.length("text")).alias("c"))
    ratio = F.when(F.col("t") > 0, F.col("c") / F.col("t")).otherwise(0.0)
    label = F.when(ratio < 0.6, "Internal CoT").when(ratio < 1.0, "Thinking tokens").otherwise("Standard")
    return g.select("model", F.round("t", 4).alias("mean_tokens"), F.round("c", 4).alias("mean_chars"), F.round(ratio, 6).alias("ratio"), label.alias("label"))


def errors_by_difficulty(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("model", "difficulty").agg(F.count_if(~F.col("correct")).alias("errors"), F.count("*").alias("total"))
    return g.withColumn("rate", F.round(F.col("errors") * 100.0 / F.col("total"), 4))


def first_truth(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row a key: the last in order, as a later text of the same question overwrites an earlier one."""
    w = Window.partitionBy(key).orderBy(F.desc(ordinal))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
