"""Results of each question by itself, as a live session shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coercion
from ..operators.scores import BASE


def question_scores(cube: DataFrame, names: list[str], mode: str = BASE) -> DataFrame:
    """question, rank, model, peer, self of every named model; one without a peer score ranks as 0, ties go by the order of names."""
    c = cube.where(F.col("mode") == mode)
    order = F.posexplode(F.array(*map(F.lit, names))).alias("model_ord", "model")
    own = F.col("evaluator") == F.col("model")
    g = c.groupBy("question", "model").agg(F.avg(F.when(~own, F.col("score"))).alias("peer"), F.max(F.when(own, F.col("score"))).alias("self"))
    every = c.select("question").distinct().select("question", order).join(g, ["question", "model"], "left")
    w = Window.partitionBy("question").orderBy(F.desc(F.coalesce("peer", F.lit(0.0))), "model_ord")
    return every.select("question", F.row_number().over(w).alias("rank"), "model", F.nullif(F.col("peer"), F.lit(0.0)).alias("peer"), "self")


def question_results(cube: DataFrame, names: list[str]) -> DataFrame:
    """Peer and self score and self bias of the blind, shuffled mode; a peer score of 0 counts as none."""
    s = question_scores(cube, names)
    return s.select("question", "rank", "model", F.round("peer", 4).alias("peer"), "self", F.round(F.col("self") - F.col("peer"), 4).alias("self_bias"))


def question_name_bias(cube: DataFrame, names: list[str], mode: str = "shuffle_only") -> DataFrame:
    """Scores of another mode with what the blind, shuffled mode gives above them."""
    base = question_scores(cube, names).select("question", "model", F.col("peer").alias("blind"))
    s = question_scores(cube, names, mode).join(base, ["question", "model"], "left")
    return s.select("question", "rank", "model", F.round("peer", 4).alias("score"), F.round(F.col("blind") - F.col("peer"), 4).alias("name_bias"))


def session_facts(sessions: DataFrame, names: list[str], mode: str = BASE, question: str = "q1", policy: str = "lenient") -> DataFrame:
    """The cube of a session of one question from sessions (evaluator, scores: a map of model to JSON cell); evaluators without scores drop out."""
    place = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])
    cells = sessions.where("size(scores) > 0").select("evaluator", F.explode("scores").alias("model", "cell"))
    score = coercion.POLICIES[policy](F.col("cell")).alias("score")
    return cells.select(F.lit(mode).alias("mode"), "evaluator", F.element_at(place, F.col("evaluator")).alias("evaluator_ord"), F.lit(question).alias("question"), F.lit(0).alias("q_ord"), "model", F.element_at(place, F.col("model")).alias("model_ord"), score)
