"""Temporary views for SQL, and the data behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures
from ..functions.text import text_colour
from ..operators import costs, inference, questions, scores


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Every table and the main views by name, for spark.sql; returns the names."""
    cube, models, qs = fixtures.scores(spark, sf_dir), fixtures.models(spark, sf_dir), fixtures.questions(spark, sf_dir)
    made = {
        "models": models,
        "questions": qs,
        "score_facts": cube,
        "timings": fixtures.timings(spark, sf_dir),
        "answers": fixtures.answers(spark, sf_dir),
        "peer_rankings": scores.peer_rankings(cube),
        "judge_generosity": scores.judge_generosity(cube),
        "question_stats": questions.question_stats(cube),
        "cross_matrix": scores.cross_matrix(cube),
        "home_advantage": inference.home_advantage(cube, qs),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)


def score_and_time(cube: DataFrame, samples: DataFrame) -> DataFrame:
    """Peer mean against mean seconds, with the medians that part the quadrants."""
    j = scores.peer_stats(cube).select("model", "peer").join(costs.timing(samples).select("model", F.col("mean").alias("seconds")), "model")
    m = j.agg(F.median("peer").alias("mid_peer"), F.median("seconds").alias("mid_seconds"), F.lit(1).alias("one"))
    j = j.withColumn("one", F.lit(1)).join(F.broadcast(m), "one")
    return j.select("model", F.round("peer", 4).alias("peer"), "seconds", F.round("mid_peer", 4).alias("mid_peer"), F.round("mid_seconds", 4).alias("mid_seconds"))


def radar(cube: DataFrame, samples: DataFrame) -> DataFrame:
    """Five axes of each model, each clamped to 0 to 1."""
    clamp = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)
    s = scores.peer_stats(cube).select("model", "peer", "sd", "self_minus_peer")
    j = s.join(costs.timing(samples).select("model", F.col("mean").alias("t")), "model")
    given = scores.peer_cells(cube).groupBy(F.col("evaluator").alias("model")).agg(F.avg("score").alias("given"))
    j = j.join(given, "model")
    top = lambda c: F.nullif(F.max(c).over(Window.partitionBy()), F.lit(0.0))
    return j.select("model", clamp(F.col("peer") / 10).alias("score"), clamp(1 - F.coalesce(F.col("sd") / top("sd"), F.lit(0.0))).alias("steadiness"), clamp(1 - F.coalesce(F.col("t") / top("t"), F.lit(0.0))).alias("speed"), clamp(0.5 - F.col("self_minus_peer") / 4).alias("humility"), clamp(1 - (F.col("given") - 5) / 5).alias("rigour"))


def text_colours(models: DataFrame) -> DataFrame:
    """A background from the ordinal, and the text colour that reads on it."""
    colour = F.concat(F.lit("#"), F.lpad(F.conv(((F.col("ordinal") * 1398101) % 16777216).cast("string"), 10, 16), 6, "0"))
    return models.select("name", colour.alias("background"), text_colour(colour).alias("text"))
