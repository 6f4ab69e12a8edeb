"""Markdown of small results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import analysis_prompt
from ..functions.text import bar
from ..operators import agreement, benchmark, costs, elo, inference, questions, scores
from ..sources.providers import Client, asked
from .phases import MODES

METHOD = (
    "Every model answers every question and grades all answers in three modes: shuffled with names, hidden in fixed order, and shuffled and hidden, "
    "which is the baseline. Peer scores leave out a model's grades of itself. Name bias is the shuffled mode less the baseline, position bias the fixed "
    "order less the baseline, self bias a model's own grade less its peers'. Elo starts at 1500 and moves by at most 32 a match; the efficiency is a power "
    "of the peer score over the cost in cents. Intervals are of 95 %; three stars stand for p under 0.001, two under 0.01, one under 0.05."
)


def table(df: DataFrame, right: tuple[str, ...] = (), centre: tuple[str, ...] = ()) -> str:
    """A Markdown table, columns as wide as their widest cell, to the left unless named. df is a finished summary of a few rows."""
    rows = [["-" if v is None else f"{v:.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v) for v in r] for r in df.collect()]
    widths = [max([3, len(c), *(len(r[k]) for r in rows)]) for k, c in enumerate(df.columns)]
    pad = lambda v, k: v.rjust(widths[k]) if df.columns[k] in right else v.center(widths[k]) if df.columns[k] in centre else v.ljust(widths[k])
    line = lambda cells: "| " + " | ".join(pad(v, k) for k, v in enumerate(cells)) + " |"
    rule = "|" + "|".join((":" if c in centre else "-") + "-" * w + (":" if c in right or c in centre else "-") for c, w in zip(df.columns, widths, strict=True)) + "|"
    return "\n".join([line(df.columns), rule, *map(line, rows)])


def report(cube: DataFrame, qs: DataFrame, models: DataFrame, answers: DataFrame | None = None, samples: DataFrame | None = None) -> str:
    """The evaluation report; costs need answers (with q_ord, model, model_ord, in_tok, out_tok) and run times samples (model, seconds)."""
    stats = questions.question_stats(cube)
    roster = cube.select("model", "model_ord").distinct()
    home = inference.home_advantage(cube, qs)
    outcomes = elo.matches(cube.where(F.col("mode") == scores.BASE))
    parts = [
        ("Peer rankings", scores.peer_rankings(cube).orderBy("rank")),
        ("Rankings by category", scores.category_rankings(cube, qs, roster)),
        ("Question coverage", scores.coverage(qs)),
        ("Elo", elo.standings(outcomes, roster).orderBy("rank")),
        ("Self bias", scores.self_bias(cube)),
        ("Judge generosity", scores.judge_generosity(cube).orderBy("rank")),
        ("Position bias", scores.position_bias(cube).orderBy("position")),
        ("Judge agreement", agreement.extremes(cube)),
        ("Providers", inference.provider_means(cube, models).orderBy("provider")),
        ("Differences between providers", inference.kruskal(cube, models)),
        ("Home advantage", home.orderBy("model")),
        ("Home advantage in all", inference.home_summary(home)),
        ("Hardest questions", questions.top(stats, "mean", False)),
        ("Easiest questions", questions.top(stats, "mean", True)),
        ("Most disputed questions", questions.top(stats, "sd", True)),
        ("Most agreed questions", questions.top(stats, "sd", False)),
    ]
    if answers is not None:
        parts.append(("Costs", costs.cost_table(answers, models)))
        parts.append(("Efficiency", costs.efficiency(scores.peer_stats(cube).select("model", "model_ord", "peer"), answers, models)))
    if samples is not None:
        parts.append(("Run times", costs.timing(samples).orderBy("model")))
    if cube.select("mode").distinct().count() == len(MODES):
        parts.append(("Name bias", scores.biases_with_errors(cube).orderBy(F.desc("name_bias"), "model")))
    parts.append(("Significance of home advantage", inference.marked(home).orderBy("model")))
    parts.append(("Peer scores as bars", scores.peer_rankings(cube).orderBy("rank").select("model", bar(F.col("peer")).alias("bar"), "peer")))
    if answers is not None:
        parts.append(("Refusals", costs.refused(answers).groupBy("model").agg(F.count("*").alias("refused")).orderBy(F.desc("refused"), "model")))
    if samples is not None:
        parts.append(("Failures", costs.failed(samples).orderBy("model")))
    return "\n\n".join([*(f"## {title}\n\n{table(df)}" for title, df in parts), f"## Method\n\n{METHOD}"]) + "\n"


def judge_report(answers: DataFrame, models: DataFrame, cube: DataFrame, written: str, judge: str, connect: Callable[[str], Client], limits: dict[str, int] | None = None) -> str:
    """Costs, efficiency and estimated input of the models, and what one of them as judge says of a written report.

    models: name, provider, model_id, ordinal, in_per_m, out_per_m. A judge that is not of the models, or whose call
    fails, leaves its part with the reason.
    """
    peer = scores.peer_stats(cube).select("model", "model_ord", "peer")
    parts = [("Costs of answers", costs.cost_table(answers, models)), ("Score and cost", costs.efficiency(peer, answers, models).orderBy("rank"))]
    asked_of = models.where(F.col("name") == judge).limit(1).select("provider", "model_id", analysis_prompt(F.lit(written)).alias("prompt"))
    said = asked(asked_of, [r[0] for r in asked_of.select("provider").collect()], connect, limits).select("text", "error").first()
    text = "no such model" if said is None else said.error if said.text is None else said.text
    return f"# Analysis by {judge}\n\n{text}\n\n" + "\n\n".join(f"## {title}\n\n{table(df)}" for title, df in parts) + "\n"


def validation_report(cube: DataFrame, accuracies: DataFrame, name: str) -> str:
    """How peer scores agree with a benchmark of known answers; accuracies as benchmark.accuracy() gives them."""
    c = benchmark.comparison(cube, accuracies)
    parts = [
        ("Scores and ranks", benchmark.shown(c).orderBy("peer_rank")),
        ("Accuracy", accuracies.select("model", "correct", "total", "accuracy").orderBy(F.desc("accuracy"), "model")),
        ("Accuracy intervals", benchmark.accuracy_intervals(accuracies).orderBy("model")),
        ("Peer score intervals", benchmark.score_intervals(cube).orderBy("model")),
        ("Correlation", benchmark.correlated(c)),
        ("Significance", benchmark.correlated_with_p(c)),
        ("Rank agreement", benchmark.rank_agreement(c)),
        ("Over- and under-rated", benchmark.misjudged(c)),
        ("Ablation", benchmark.ablation(cube, accuracies)),
        ("Conclusion", benchmark.fit_quality(c)),
    ]
    return f"# {name}\n\n" + "\n\n".join(f"## {title}\n\n{table(df)}" for title, df in parts) + "\n"


def table_rows(reports: DataFrame, names: tuple[str, ...] = (), holding: str = "") -> DataFrame:
    """file, header, row, cells of the first table of each report (file, text) whose header line holds all the names.

    A report is one row, whose lines are walked in their order within it. The table ends at its first line that does
    not begin with a bar; the rule under the header is none of its rows, nor is a line without `holding`. Empty cells
    drop out. A report without such a table has no rows.
    """
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    barred = lambda line: F.ltrim(line).startswith("|")

    def heads(line: Column) -> Column:
        found = barred(line)
        for n in names:
            found = found & F.contains(line, F.lit(n))
        return found

    lines = reports.select("file", F.split("text", r"\r?\n").alias("lines"))
    at = F.array_position(F.transform("lines", heads), F.lit(True)).cast("int")
    found = lines.withColumn("at", at).where("at > 0").select("file", F.element_at("lines", F.col("at")).alias("head"), F.slice("lines", F.col("at") + 1, F.size("lines")).alias("rest"))
    stop = F.array_position(F.transform("rest", lambda x: ~barred(x)), F.lit(True)).cast("int")
    body = F.when(stop > 0, F.slice("rest", F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(F.col("rest"))
    body = F.filter(body, lambda x: ~x.rlike(r"^[|:\- ]+$") & F.contains(x, F.lit(holding)))
    rows = found.select("file", cells(F.col("head")).alias("header"), F.posexplode(body).alias("row", "line"))
    return rows.select("file", "header", "row", cells(F.col("line")).alias("cells"))


def table_cells(rows: DataFrame) -> DataFrame:
    """file, row, name (the row's first cell), column, cell and score of rows with their header, as table_rows() gives them."""
    named = F.arrays_zip(F.slice("header", 2, F.greatest(F.size("header") - 1, F.lit(0))).alias("column"), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("cell"))
    c = rows.select("file", "row", F.get("cells", F.lit(0)).alias("name"), F.explode(named).alias("c")).select("file", "row", "name", "c.column", "c.cell")
    return c.where("column IS NOT NULL AND cell IS NOT NULL").withColumn("score", ranked_score(F.col("cell")))


def ranked_score(cell: Column) -> Column:
    """The score of a cell such as "1 (8.72)"; null without one."""
    return F.regexp_extract(cell, r"\(([0-9.]+)\)", 1).try_cast("double")
