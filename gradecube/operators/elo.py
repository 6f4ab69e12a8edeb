"""Pairwise outcomes and Elo ratings.

Outcomes come from an equi-join of a judge's cells for one question, so a cell meets at most as many rows as there are
models. Ratings depend on the order of matches and cannot be summed in parts: matches are dealt by group, sorted
there with spilling, and folded as a stream that holds one rating a model.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coercion
from . import names
from .scores import is_peer

START, K, SCALE, SEED = 1500.0, 32.0, 400.0, 42
#: In list order shuffled by Python, a mode may have at most so many matches: they are held in one task.
MOST_DRAWN = 10_000_000


def matches(cube: DataFrame, seed: int = SEED) -> DataFrame:
    """mode, evaluator_ord, q_ord, a, b (model_ord), outcome of a (1, 0.5, 0) and the md5 key that orders the fold."""
    c = cube.where(is_peer())
    a = c.select("mode", "evaluator_ord", "q_ord", F.col("model_ord").alias("a"), F.col("score").alias("x"))
    b = c.select("mode", "evaluator_ord", "q_ord", F.col("model_ord").alias("b"), F.col("score").alias("y"))
    j = a.join(b, ["mode", "evaluator_ord", "q_ord"]).where("a < b")
    outcome = F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") < F.col("y"), 0.0).otherwise(0.5)
    return j.select("mode", "evaluator_ord", "q_ord", "a", "b", outcome.alias("outcome"), F.md5(F.concat_ws("|", F.lit(str(seed)), "evaluator_ord", "q_ord", "a", "b")).alias("ord"))


def resolved(raw: DataFrame, roster: DataFrame) -> DataFrame:
    """A cube (mode, evaluator, evaluator_ord, q_ord, model, model_ord, score) of raw cells under the elo policy.

    raw: mode, evaluator, evaluator_ord, q_ord, model, position, cell, with names as judges wrote them; roster: name,
    ordinal. Models that no one of the roster is meant by drop out, and so do cells without a whole number; of cells
    that mean one model the last by position counts. A judge who is not of the roster is nobody's self.
    """
    written = raw.select(F.col("model").alias("name")).unionByName(raw.select(F.col("evaluator").alias("name")))
    known = names.matched(written, roster).where("model IS NOT NULL").join(roster.select(F.col("name").alias("model"), "ordinal"), "model")
    cells = raw.withColumn("score", coercion.elo(F.col("cell"))).where("score IS NOT NULL")
    cells = cells.withColumnRenamed("model", "written").join(known.select(F.col("name").alias("written"), "model", F.col("ordinal").alias("model_ord")), "written")
    cells = cells.join(known.select(F.col("name").alias("evaluator"), F.col("model").alias("judge")), "evaluator", "left")
    judge = F.coalesce("judge", "evaluator")
    last = F.max_by("score", "position").alias("score")
    return cells.groupBy("mode", judge.alias("evaluator"), "evaluator_ord", "q_ord", "model", "model_ord").agg(last)


def tallies(m: DataFrame) -> DataFrame:
    """Wins, losses, ties and the win rate of each model of each mode."""
    both = m.select("mode", F.col("a").alias("model_ord"), "outcome").unionByName(m.select("mode", F.col("b").alias("model_ord"), (1.0 - F.col("outcome")).alias("outcome")))
    g = both.groupBy("mode", "model_ord").agg(F.count_if(F.col("outcome") == 1).alias("wins"), F.count_if(F.col("outcome") == 0).alias("losses"), F.count_if(F.col("outcome") == 0.5).alias("ties"))
    total = F.col("wins") + F.col("losses") + F.col("ties")
    return g.withColumn("win_rate", F.when(total > 0, F.round((F.col("wins") + 0.5 * F.col("ties")) / total * 100, 4)).otherwise(0.0))


def step(ratings: dict, a: int, b: int, outcome: float, k: float = K, scale: float = SCALE, start: float = START) -> None:
    ra, rb = ratings.get(a, start), ratings.get(b, start)
    expected = 1 / (1 + 10 ** ((rb - ra) / scale))
    ratings[a], ratings[b] = ra + k * (outcome - expected), rb + k * (expected - outcome)


def ratings(m: DataFrame, start: float = START, k: float = K) -> DataFrame:
    """mode, model_ord, elo (rounded half to even) and rating after all matches in key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mode, table, out = None, {}, []
        for batch in batches:
            for g, a, b, o in zip(*(batch.column(c).to_pylist() for c in ("mode", "a", "b", "outcome")), strict=True):
                if g != mode:
                    out += [(mode, i, r) for i, r in table.items()]
                    mode, table = g, {}
                step(table, a, b, o, k, SCALE, start)
        out += [(mode, i, r) for i, r in table.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([round(x[2]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["mode", "model_ord", "elo", "rating"])

    dealt = m.repartition("mode").sortWithinPartitions("mode", "ord")
    return dealt.mapInArrow(run, "mode string, model_ord int, elo long, rating double")


def standings(m: DataFrame, roster: DataFrame) -> DataFrame:
    """rank, model, elo, win_rate and the tally W-L-T of each model of the matches of one mode."""
    t = tallies(m).join(ratings(m), ["mode", "model_ord"]).join(roster.select("model", "model_ord"), "model_ord")
    rank = F.row_number().over(Window.orderBy(F.desc("elo"), "model_ord")).cast("long")
    return t.select(rank.alias("rank"), "model", "elo", F.round("win_rate", 1).alias("win_rate"), F.concat_ws("-", "wins", "losses", "ties").alias("tally"))


def against_peer(elo: DataFrame, peer: DataFrame) -> DataFrame:
    """Elo beside peer rank; peer has model, model_ord, peer. Models that miss one have 0 there."""
    j = peer.join(elo.select("model_ord", "elo"), "model_ord", "left").na.fill(0, ["elo"])
    r = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "model_ord")).cast("long")
    out = j.withColumn("peer_rank", r("peer")).withColumn("elo_rank", r("elo"))
    return out.select("model", "elo", F.round("peer", 4).alias("peer"), "peer_rank", "elo_rank", (F.col("peer_rank") - F.col("elo_rank")).alias("rank_diff"))


def ratings_in_drawn_order(cube: DataFrame, seed: int | None = SEED, start: float = START, k: float = K) -> DataFrame:
    """As ratings(), with the matches of a mode in list order shuffled by Python's generator; no shuffle for seed None.

    For parity with single-process runs: a mode's matches are held in one task, so more than MOST_DRAWN of a mode are
    refused; ratings() has no such bound.
    """
    m = matches(cube)
    if m.groupBy("mode").count().where(F.col("count") > MOST_DRAWN).head(1):
        raise ValueError(f"a mode has over {MOST_DRAWN} matches; use ratings()")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for batch in batches:
            for g, a, b, o in zip(*(batch.column(c).to_pylist() for c in ("mode", "a", "b", "outcome")), strict=True):
                groups.setdefault(g, []).append((a, b, o))
        out = []
        for g, rows in groups.items():
            if seed is not None:
                random.Random(seed).shuffle(rows)
            table: dict = {}
            for a, b, o in rows:
                step(table, a, b, o, k, SCALE, start)
            out += [(g, i, r) for i, r in table.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([round(x[2]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["mode", "model_ord", "elo", "rating"])

    return m.repartition("mode").sortWithinPartitions("mode", "evaluator_ord", "q_ord", "a", "b").mapInArrow(run, "mode string, model_ord int, elo long, rating double")
