"""Home advantage, provider clustering, ranks and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import cohens_d, normal_tail, pearson, safe, stars, welch_t
from .scores import BASE, peer_cells, rank_by

LEAST = 3


def with_source(cube: DataFrame, questions: DataFrame, mode: str = BASE) -> DataFrame:
    return peer_cells(cube, mode).join(questions.select("question", "source_model"), "question")


def home_advantage(cube: DataFrame, questions: DataFrame) -> DataFrame:
    """Peer means of a model on its own questions and on others', with Welch's t, a normal p and Cohen's d; three of each at least."""
    own = F.col("source_model") == F.col("model")
    a, b = F.when(own, F.col("score")), F.when(~own, F.col("score"))
    g = with_source(cube, questions).groupBy("model").agg(F.avg(a).alias("own"), F.avg(b).alias("other"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"), F.count(a).alias("n_own"), F.count(b).alias("n_other"))
    g = g.where((F.col("n_own") >= LEAST) & (F.col("n_other") >= LEAST))
    args = [F.col(c) for c in ("own", "v1", "n_own", "other", "v2", "n_other")]
    t = welch_t(*args)
    return g.select("model", F.round("own", 4).alias("own"), F.round("other", 4).alias("other"), F.round(F.col("own") - F.col("other"), 4).alias("diff"), "n_own", "n_other", F.round(t, 4).alias("t"), F.round(normal_tail(t), 6).alias("p"), F.round(cohens_d(*args), 4).alias("d"))


def home_summary(h: DataFrame) -> DataFrame:
    """How many advantages are significant either way; a p of exactly 0 is not counted so."""
    sure = F.coalesce((F.col("p") > 0) & (F.col("p") < 0.05), F.lit(False))
    return h.agg(F.count_if(sure & (F.col("diff") > 0)).alias("positive"), F.count_if(sure & (F.col("diff") < 0)).alias("negative"), F.count_if(~sure | (F.col("diff") == 0)).alias("neither"), F.round(F.avg("diff"), 4).alias("mean_diff"))


def marked(h: DataFrame) -> DataFrame:
    return h.select("model", "diff", stars(F.col("p")).alias("stars"))


def source_difficulty(cube: DataFrame, questions: DataFrame) -> DataFrame:
    return with_source(cube, questions).groupBy("source_model").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"))


def with_provider(cube: DataFrame, models: DataFrame, mode: str = BASE) -> DataFrame:
    m = F.broadcast(models.select(F.col("name").alias("model"), "provider"))
    return peer_cells(cube, mode).join(m, "model", "left").withColumn("provider", F.coalesce("provider", F.lit("Other")))


def provider_means(cube: DataFrame, models: DataFrame) -> DataFrame:
    return with_provider(cube, models).groupBy("provider").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


def kruskal(cube: DataFrame, models: DataFrame) -> DataFrame:
    """Kruskal-Wallis H over providers with tie correction, its degrees of freedom and eta squared.

    Mid-ranks come from counts by score, of which there are few, not from a sort of all scores.
    """
    cells = with_provider(cube, models)
    by_score = cells.groupBy("score").agg(F.count("*").alias("c"))
    up_to = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by_score.select("score", "c", (F.sum("c").over(up_to) - (F.col("c") - 1) / 2.0).alias("rk"))
    groups = cells.groupBy("provider", "score").agg(F.count("*").alias("k")).join(F.broadcast(ranked.select("score", "rk")), "score")
    groups = groups.groupBy("provider").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rk")).alias("r")).where("n >= 2")
    totals = groups.agg(F.sum("n").cast("double").alias("N"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k"), F.lit(1).alias("one")).where("k >= 2")
    ties = by_score.agg(F.sum(F.col("c").cast("double") * F.col("c") * F.col("c") - F.col("c")).alias("t"), F.lit(1).alias("one"))
    n = F.col("N")
    h = safe(12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("t") / (n * n * n - n))
    return totals.join(ties, "one").select(F.round(h, 6).alias("h"), (F.col("k") - 1).alias("df"), n.cast("long").alias("n"), F.round(h / (n - 1), 8).alias("eta2"))


def mid_rank(x: Column, *parts: str) -> Column:
    """Rank from the highest value down; ties share the mean of their places.

    Without parts all rows are ranked in one task, so this is for tables of one row a model.
    """
    return F.rank().over(Window.partitionBy(*parts).orderBy(x.desc())) + (F.count("*").over(Window.partitionBy(*parts, x)) - 1) / 2.0


def generosity_and_peer(cube: DataFrame) -> DataFrame:
    """Each model's peer mean and, as a judge, the mean it gives."""
    c = peer_cells(cube)
    got = c.groupBy("model").agg(F.avg("score").alias("peer"))
    return got.join(c.groupBy(F.col("evaluator").alias("model")).agg(F.avg("score").alias("given")), "model")


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation and the line of least squares of y on x."""
    r = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).withColumn("rx", mid_rank(F.col("x"))).withColumn("ry", mid_rank(F.col("y")))
    n = F.count("*").cast("double")
    var = n * F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x")
    slope = safe(n * F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.sum("y"), var)
    return r.agg(F.count("*").alias("n"), F.round(pearson("x", "y"), 6).alias("pearson"), F.round(pearson("rx", "ry"), 6).alias("spearman"), F.round(slope, 6).alias("slope"), F.round((F.sum("y") - slope * F.sum("x")) / n, 6).alias("intercept"))


def ranked(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    return rows.withColumn("rank", rank_by(F.desc(value), F.col(ordinal)))
