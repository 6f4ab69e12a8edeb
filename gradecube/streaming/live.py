"""Score facts as a stream: running totals of peer scores, and rankings of each question that take corrections."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def peer_totals(facts: DataFrame) -> DataFrame:
    """Running sum and number of peer scores by mode and model; works on a stream or a table."""
    return facts.where("evaluator <> model").groupBy("mode", "model").agg(F.sum("score").alias("total"), F.count("score").alias("n"))


def start(facts: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """The running totals as an in-memory table of the given name, complete after each batch."""
    return peer_totals(facts).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


RANKING = "question string, mode string, rank int, model string, peer double, self double, cells int"


def latest(facts: DataFrame) -> DataFrame:
    """The facts (mode, evaluator, question, model, score, version) that stand: of each cell its last version, unless that has no score."""
    cell = ["mode", "evaluator", "question", "model"]
    last = facts.groupBy(*cell).agg(F.max_by("score", "version").alias("score"))
    return last.where("score IS NOT NULL")


def session_rankings(facts: DataFrame, names: list[str]) -> DataFrame:
    """Rankings of a question in each mode after every batch in which a cell of it came or changed.

    facts: a stream as latest() takes it. The state of a question is its cells, at most modes times the square of the
    models, each with its version: a later version of a cell replaces it, one without a score takes it back, an older one that
    comes late changes nothing. A named model without a peer score ranks as 0; ties go by the order of names.
    A mode all of whose cells were taken back gives no rows.
    """

    def ranked(question: str, cells: dict[str, list]) -> list[tuple]:
        by_mode: dict[str, list] = {}
        for key, (_, score) in cells.items():
            mode, evaluator, model = json.loads(key)
            if score is not None:
                by_mode.setdefault(mode, []).append((evaluator, model, score))
        out = []
        for mode, own in by_mode.items():
            peers = {m: [s for e, x, s in own if x == m != e] for m in names}
            selves = {m: next((s for e, x, s in own if x == m == e), None) for m in names}
            means = {m: sum(v) / len(v) if v else None for m, v in peers.items()}
            order = sorted(names, key=lambda m: -(means[m] or 0))
            out += [(question, mode, k + 1, m, means[m] or None, selves[m], len(own)) for k, m in enumerate(order)]
        return out

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        cells = json.loads(state.get[0]) if state.exists else {}
        for part in parts:
            for mode, evaluator, model, score, version in part[["mode", "evaluator", "model", "score", "version"]].itertuples(index=False):
                cell = json.dumps([mode, evaluator, model])
                if cell not in cells or cells[cell][0] <= version:
                    cells[cell] = [int(version), None if pd.isna(score) else float(score)]
        state.update((json.dumps(cells),))
        yield pd.DataFrame(ranked(key[0], cells), columns=[c.split()[0] for c in RANKING.split(", ")])

    return facts.groupBy("question").applyInPandasWithState(update, RANKING, "cells string", "update", "NoTimeout")
