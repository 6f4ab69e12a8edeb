"""Every query of the engine over the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import coercion, prompts, special, stats, text
from .operators import agreement, benchmark, catalog, costs, elo, incremental, inference, names, questions, rules, sampling, scores
from .plans import analysis, phases, report, single, validation, views
from .sources import folders, json_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, tables: bool = True):
    """Register a function of (spark, sf_dir) and the SQL that must give the same rows; tables puts the engine's tables before it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = (fx.SQL if tables else "") + sql
        return f

    return add


def roster(s: SparkSession, d: str) -> DataFrame:
    return s.range(fx.N_MODELS).select(F.concat(F.lit("NATION_"), F.col("id").cast("string")).alias("model"), F.col("id").cast("int").alias("model_ord"))


def t_two_sided_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, by its finite sums of powers of the cosine."""
    cos2, sin = f"({df} / ({df} + ({t}) * ({t})))", f"(abs({t}) / sqrt({df} + ({t}) * ({t})))"
    even = f"{sin} * coalesce(list_sum(list_transform(range(({df} // 2)::bigint), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * pow({cos2}, j))), 0)"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {sin} * sqrt({cos2}) * coalesce(list_sum(list_transform(range((({df} - 1) // 2)::bigint), lambda j: exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * pow({cos2}, j))), 0))"
    return f"(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def pearson_p_sql(r: str, n: str) -> str:
    return f"CASE WHEN {n} >= 3 THEN CASE WHEN abs({r}) >= 1 THEN 0 ELSE {t_two_sided_sql(f'{r} * sqrt(({n} - 2) / (1 - {r} * {r}))', f'({n} - 2)')} END END"


ROSTER = ", roster AS (SELECT concat('NATION_', i::varchar) AS model, i::int AS model_ord FROM range(12) t(i))\n"
STATS = """, st AS (SELECT model, model_ord, avg(score) FILTER (evaluator <> model) AS peer, coalesce(stddev_samp(score) FILTER (evaluator <> model), 0) AS sd, count(*) FILTER (evaluator <> model) AS n,
  coalesce(avg(score) FILTER (evaluator = model), 0) AS self, count(*) FILTER (evaluator = model) AS n_self, avg(score) AS raw FROM f_scores WHERE mode = 'shuffle_blind' GROUP BY 1, 2)
"""
MODES = """, ms AS (SELECT mode, model, model_ord, avg(score) FILTER (evaluator <> model) AS pm, stddev_pop(score) FILTER (evaluator <> model) AS psd, count(*) FILTER (evaluator <> model) AS pn,
  CASE WHEN count(*) FILTER (evaluator <> model) > 1 THEN stddev_samp(score) FILTER (evaluator <> model) / sqrt(count(*) FILTER (evaluator <> model)) ELSE 0 END AS pse,
  avg(score) FILTER (evaluator = model) AS sm, stddev_pop(score) FILTER (evaluator = model) AS ssd, count(*) FILTER (evaluator = model) AS sn,
  CASE WHEN count(*) FILTER (evaluator = model) > 1 THEN stddev_samp(score) FILTER (evaluator = model) / sqrt(count(*) FILTER (evaluator = model)) ELSE 0 END AS sse FROM f_scores GROUP BY 1, 2, 3)
"""


# scores and biases
@query(STATS + "SELECT row_number() OVER (ORDER BY peer DESC, model_ord) AS rank, model, round(peer, 4) AS peer, round(sd, 4) AS sd, round(self, 4) AS self, round(self - peer, 4) AS self_minus_peer, round(raw, 4) AS raw, n FROM st WHERE n > 0")
def peer_rankings(s, d):
    return scores.peer_rankings(fx.scores(s, d))


@query(STATS + "SELECT model, round(peer, 4) AS peer, round(raw, 4) AS raw, round(raw - peer, 4) AS diff FROM st WHERE n > 0")
def peer_vs_raw(s, d):
    return scores.peer_stats(fx.scores(s, d)).select("model", F.round("peer", 4).alias("peer"), F.round("raw", 4).alias("raw"), F.round(F.col("raw") - F.col("peer"), 4).alias("diff"))


@query("SELECT model, round(avg(score), 4) AS self, count(*) AS n FROM f_scores WHERE mode = 'shuffle_blind' AND evaluator = model GROUP BY 1")
def self_scores(s, d):
    return fx.scores(s, d).where("mode = 'shuffle_blind' AND evaluator = model").groupBy("model").agg(F.round(F.avg("score"), 4).alias("self"), F.count("*").alias("n"))


for _missing, _value in (("zero", "round(self - peer, 4)"), ("neutral", "0::double"), ("null", "NULL::double")):
    query(STATS + f"SELECT model, n_self, CASE WHEN n_self > 0 THEN round(self - peer, 4) ELSE {_value} END AS self_bias FROM st WHERE n > 0", "self_bias" if _missing == "zero" else f"self_bias_{_missing}")(lambda s, d, m=_missing: scores.self_bias(fx.scores(s, d), missing=m))


@query("SELECT row_number() OVER (ORDER BY avg(score) DESC, evaluator_ord) AS rank, evaluator, round(avg(score), 4) AS given, round(coalesce(stddev_samp(score), 0), 4) AS sd, round(stddev_pop(score), 4) AS sd_pop, count(*) AS n FROM peer GROUP BY evaluator, evaluator_ord")
def judge_generosity(s, d):
    return scores.judge_generosity(fx.scores(s, d))


@query(MODES + "SELECT mode, model, round(pm, 4) AS peer, round(sm, 4) AS self, pn AS n_peer, sn AS n_self FROM ms")
def mode_scores(s, d):
    return scores.mode_stats(fx.scores(s, d)).select("mode", "model", F.round("peer_mean", 4).alias("peer"), F.round("self_mean", 4).alias("self"), F.col("peer_n").alias("n_peer"), F.col("self_n").alias("n_self"))


@query(MODES + "SELECT mode, model, round(psd, 4) AS peer_sd, round(pse, 4) AS peer_se, round(ssd, 4) AS self_sd, round(sse, 4) AS self_se FROM ms")
def mode_standard_errors(s, d):
    return scores.mode_stats(fx.scores(s, d)).select("mode", "model", *[F.round(c, 4).alias(c) for c in ("peer_sd", "peer_se", "self_sd", "self_se")])


BIAS = ROSTER + """, bs AS (SELECT r.model, coalesce(avg(score) FILTER (mode = 'shuffle_blind' AND evaluator <> f.model), 0) AS base, coalesce(avg(score) FILTER (mode = 'shuffle_only' AND evaluator <> f.model), 0) AS names,
  coalesce(avg(score) FILTER (mode = 'blind_only' AND evaluator <> f.model), 0) AS places FROM roster r LEFT JOIN f_scores f ON f.model = r.model GROUP BY 1)
"""


@query(BIAS + "SELECT model, round(names - base, 4) AS name_bias, round(base, 4) AS base FROM bs")
def name_bias(s, d):
    return scores.bias_analysis(fx.scores(s, d), roster(s, d)).select("model", F.round("name_bias", 4).alias("name_bias"), F.round("base", 4).alias("base"))


@query(MODES + "SELECT (a.model_ord + 1)::int AS position, a.model, round(a.pm, 4) AS blind, round(b.pm, 4) AS peer, round(a.pm - b.pm, 4) AS bias, round(sqrt(a.pse ** 2 + b.pse ** 2), 4) AS se, a.pn AS n_blind, b.pn AS n_peer FROM ms a JOIN ms b ON a.model = b.model WHERE a.mode = 'blind_only' AND b.mode = 'shuffle_blind'")
def position_bias(s, d):
    return scores.position_bias(fx.scores(s, d))


@query(MODES + "SELECT a.model, round(b.pm - a.pm, 4) AS name_bias, round(1.96 * sqrt(a.pse ** 2 + b.pse ** 2), 4) AS name_ci95, round(a.sm - a.pm, 4) AS self_bias, round(1.96 * sqrt(a.pse ** 2 + a.sse ** 2), 4) AS self_ci95 FROM ms a JOIN ms b ON a.model = b.model WHERE a.mode = 'shuffle_blind' AND b.mode = 'shuffle_only'")
def bias_ci95(s, d):
    return scores.biases_with_errors(fx.scores(s, d))


@query(MODES + "SELECT mode, round(avg(sm - pm), 4) AS self_bias, count(*) AS models FROM ms WHERE sn > 0 AND pn > 0 GROUP BY 1")
def self_bias_by_mode(s, d):
    return scores.self_bias_by_mode(fx.scores(s, d))


@query(BIAS + "SELECT model, round(base - places, 4) AS effect, CASE WHEN base > places THEN 'lower' ELSE 'higher' END AS fixed_order FROM bs WHERE abs(round(base - places, 4)) > 0.1")
def significant_position_effects(s, d):
    e = F.round(F.col("base") - F.col("places"), 4)
    return scores.bias_analysis(fx.scores(s, d), roster(s, d)).select("model", e.alias("effect"), F.when(F.col("base") > F.col("places"), "lower").otherwise("higher").alias("fixed_order")).where(F.abs("effect") > 0.1)


# categories
CATEGORY = ROSTER + """, cs AS (SELECT s.model, coalesce(q.category, 'unknown') AS category, s.score FROM peer s LEFT JOIN f_questions q ON s.question = q.question),
cm AS (SELECT model, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, avg(score) AS score FROM cs GROUP BY GROUPING SETS ((model, category), (model))),
cr AS (SELECT c.category, r.model, row_number() OVER (PARTITION BY c.category ORDER BY coalesce(cm.score, 0) DESC, r.model_ord) AS rank, round(coalesce(cm.score, 0), 4) AS score FROM roster r CROSS JOIN (SELECT DISTINCT category FROM cm) c LEFT JOIN cm ON cm.model = r.model AND cm.category = c.category)
"""


@query(CATEGORY + "SELECT * FROM cr")
def category_rankings(s, d):
    return scores.category_rankings(fx.scores(s, d), fx.questions(s, d), roster(s, d))


CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "overall"]


@query(CATEGORY + "SELECT model, " + ", ".join(f"max(score) FILTER (category = '{c}') AS c{k}" for k, c in enumerate(CATEGORIES)) + " FROM cr GROUP BY 1")
def category_pivot(s, d):
    p = scores.category_rankings(fx.scores(s, d), fx.questions(s, d), roster(s, d)).groupBy("model").pivot("category", CATEGORIES).agg(F.max("score"))
    return p.select("model", *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(CATEGORIES)])


@query("SELECT s.model, q.category, round(avg(score), 4) AS mean, grouping(q.category)::int AS g FROM peer s JOIN f_questions q ON s.question = q.question GROUP BY GROUPING SETS ((s.model, q.category), (s.model))")
def category_overall_sets(s, d):
    j = scores.peer_cells(fx.scores(s, d)).join(fx.questions(s, d).select("question", "category"), "question")
    return j.groupingSets([("model", "category"), ("model",)], "model", "category").agg(F.round(F.avg("score"), 4).alias("mean"), F.grouping("category").cast("int").alias("g"))


@query("SELECT CASE WHEN grouping(source_model) = 1 THEN 'TOTAL' ELSE source_model END AS source_model, CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, count(*) AS n FROM f_questions GROUP BY CUBE (source_model, category)")
def coverage_cube(s, d):
    return scores.coverage(fx.questions(s, d))


# questions
QS = ", qs AS (SELECT question, q_ord, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS sd, min(score) AS least, max(score) AS most, count(*) AS n FROM f_scores WHERE mode = 'shuffle_blind' GROUP BY 1, 2)\n"


@query(QS + "SELECT question, round(mean, 4) AS mean, round(sd, 4) AS sd, least, most, n FROM qs")
def question_stats(s, d):
    return questions.question_stats(fx.scores(s, d)).select("question", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "least", "most", "n")


@query(", m AS (SELECT question, q_ord, model, model_ord, avg(score) AS a FROM f_scores WHERE mode = 'shuffle_blind' GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY a DESC, model_ord) AS b, row_number() OVER (PARTITION BY question ORDER BY a, model_ord) AS w FROM m) SELECT question, max(model) FILTER (b = 1) AS best, max(model) FILTER (w = 1) AS worst FROM r GROUP BY 1")
def question_best_worst_model(s, d):
    return questions.best_and_worst(fx.scores(s, d)).select("question", "best", "worst")


for _name, _by, _high, _order in (("hardest5", "mean", False, "mean, q_ord"), ("easiest5", "mean", True, "mean DESC, q_ord DESC"), ("controversial5", "sd", True, "sd DESC, q_ord"), ("consensus5", "sd", False, "sd, q_ord DESC")):
    query(QS + f"SELECT row_number() OVER (ORDER BY {_order}) AS rank, question, round(mean, 4) AS mean, round(sd, 4) AS sd FROM qs QUALIFY rank <= 5", _name)(lambda s, d, b=_by, h=_high: questions.top(questions.question_stats(fx.scores(s, d)), b, h))


@query(QS + "SELECT round(median(mean), 4) AS median_mean, round(median(sd), 4) AS median_sd FROM qs")
def autopsy_medians(s, d):
    return questions.medians(questions.question_stats(fx.scores(s, d)))


# agreement
@query("SELECT evaluator, model, round(avg(score), 4) AS mean, count(*) AS n FROM f_scores WHERE mode = 'shuffle_blind' GROUP BY 1, 2")
def cross_eval_matrix(s, d):
    return scores.cross_matrix(fx.scores(s, d))


def pearson_sql(x: str, y: str, least: int = 2) -> str:
    top = f"count(*) * sum({x} * {y}) - sum({x}) * sum({y})"
    var = lambda v: f"sqrt(greatest(count(*) * sum({v} * {v}) - sum({v}) * sum({v}), 0))"
    return f"CASE WHEN count(*) < {least} THEN 0 ELSE coalesce(({top})::double / nullif({var(x)} * {var(y)}, 0), 0) END"


PAIRS = f""", pr AS (SELECT a.evaluator AS judge1, a.evaluator_ord AS o1, b.evaluator AS judge2, b.evaluator_ord AS o2, count(*) AS n, round({pearson_sql("a.score", "b.score", 3)}, 6) AS r
  FROM f_scores a JOIN f_scores b ON a.question = b.question AND a.model = b.model AND a.evaluator_ord <= b.evaluator_ord WHERE a.mode = 'shuffle_blind' AND b.mode = 'shuffle_blind' GROUP BY 1, 2, 3, 4)
"""


@query(PAIRS + "SELECT judge1, judge2, n, r FROM pr WHERE o1 < o2")
def judge_agreement_pairs(s, d):
    return agreement.pairs(fx.scores(s, d)).select("judge1", "judge2", "n", "r")


@query(PAIRS + "SELECT judge1, judge2, r FROM pr UNION ALL SELECT judge2 AS judge1, judge1 AS judge2, r FROM pr WHERE o1 < o2")
def judge_agreement_matrix(s, d):
    return agreement.matrix(fx.scores(s, d))


@query(PAIRS + ", rk AS (SELECT *, row_number() OVER (ORDER BY r DESC, o1, o2) AS t, row_number() OVER (ORDER BY r, o1 DESC, o2 DESC) AS b FROM pr WHERE o1 < o2) SELECT judge1, judge2, r, CASE WHEN t <= 3 THEN 'most' ELSE 'least' END AS side FROM rk WHERE t <= 3 OR b <= 3")
def agreement_top3_bottom3(s, d):
    return agreement.extremes(fx.scores(s, d))


@query(PAIRS + "SELECT round(coalesce(avg(r), 0), 6) AS mean_r, count(*) AS pairs FROM pr WHERE o1 < o2")
def agreement_mean(s, d):
    return agreement.mean_agreement(fx.scores(s, d))


# Elo
MATCHES = """, mt AS (SELECT a.mode, a.model_ord AS a, b.model_ord AS b, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score < b.score THEN 0.0 ELSE 0.5 END::double AS outcome, md5(concat_ws('|', '42', a.evaluator_ord, a.q_ord, a.model_ord, b.model_ord)) AS ord
  FROM f_scores a JOIN f_scores b ON a.mode = b.mode AND a.evaluator = b.evaluator AND a.question = b.question AND a.model_ord < b.model_ord WHERE a.evaluator <> a.model AND b.evaluator <> b.model),
wl AS (SELECT mode, model_ord, count(*) FILTER (o = 1) AS wins, count(*) FILTER (o = 0) AS losses, count(*) FILTER (o = 0.5) AS ties FROM (SELECT mode, a AS model_ord, outcome AS o FROM mt UNION ALL SELECT mode, b, 1 - outcome FROM mt) GROUP BY 1, 2)
"""


@query(MATCHES + "SELECT mode, a, b, outcome, ord FROM mt")
def pairwise_outcomes(s, d):
    return elo.matches(fx.scores(s, d)).select("mode", "a", "b", "outcome", "ord")


@query(MATCHES + "SELECT mode, model_ord, wins, losses, ties FROM wl")
def elo_wlt(s, d):
    return elo.tallies(elo.matches(fx.scores(s, d))).drop("win_rate")


@query(MATCHES + "SELECT mode, model_ord, CASE WHEN wins + losses + ties > 0 THEN round((wins + 0.5 * ties)::double / (wins + losses + ties) * 100, 4) ELSE 0 END AS win_rate FROM wl")
def elo_win_rates(s, d):
    return elo.tallies(elo.matches(fx.scores(s, d))).select("mode", "model_ord", "win_rate")


#: The fold as a recursion over the matches of each mode in order; a state is the list of all ratings.
FOLD = MATCHES.replace("wl AS", "mk AS MATERIALIZED (SELECT mode, a, b, outcome, row_number() OVER (PARTITION BY mode ORDER BY ord) AS k FROM mt),\nwl AS") + """, el AS (SELECT mode, 0::bigint AS k, list_transform(range(0, 12), lambda i: 1500.0::double) AS r FROM (SELECT DISTINCT mode FROM mk)
  UNION ALL SELECT el.mode, mk.k, list_transform(range(0, 12), lambda i: CASE i WHEN mk.a THEN r[i + 1] + 32.0::double * (outcome - 1 / (1 + pow(10::double, (r[mk.b + 1] - r[i + 1]) / 400.0::double)))
    WHEN mk.b THEN r[i + 1] + 32.0::double * (1 / (1 + pow(10::double, (r[i + 1] - r[mk.a + 1]) / 400.0::double)) - outcome) ELSE r[i + 1] END) AS r FROM el JOIN mk ON el.mode = mk.mode AND mk.k = el.k + 1),
rt AS (SELECT mode, model_ord, rating, round_even(rating, 0)::bigint AS elo FROM (SELECT mode, unnest(range(0, 12))::int AS model_ord, unnest(r) AS rating FROM (SELECT mode, arg_max(r, k) AS r FROM el GROUP BY 1)) SEMI JOIN wl USING (mode, model_ord))
"""


def fold_sql(rest: str) -> str:
    """Full SQL that may read rt, the ratings after the fold."""
    return (fx.SQL + FOLD).replace("WITH ", "WITH RECURSIVE ", 1) + rest


VERSUS = STATS + """, ev AS (SELECT model, model_ord, coalesce(elo, 0) AS elo, peer FROM st LEFT JOIN (SELECT * FROM rt WHERE mode = 'shuffle_blind') USING (model_ord) WHERE n > 0),
vs AS (SELECT model, elo, round(peer, 4) AS peer, row_number() OVER (ORDER BY peer DESC, model_ord) AS peer_rank, row_number() OVER (ORDER BY elo DESC, model_ord) AS elo_rank FROM ev)
"""


@query(fold_sql("SELECT mode, model_ord, elo, round(rating, 6) AS rating FROM rt"), tables=False)
def elo_ratings(s, d):
    return elo.ratings(elo.matches(fx.scores(s, d))).select("mode", "model_ord", "elo", F.round("rating", 6).alias("rating"))


@query()
def elo_ratings_drawn_order(s, d):
    return elo.ratings_in_drawn_order(fx.scores(s, d)).select("mode", "model_ord", "elo", F.round("rating", 6).alias("rating"))


def _elo_and_peer(s, d):
    cube = fx.scores(s, d)
    base = elo.ratings(elo.matches(cube.where("mode = 'shuffle_blind'")))
    return elo.against_peer(base, scores.peer_stats(cube).select("model", "model_ord", "peer"))


@query(fold_sql(VERSUS + "SELECT model, elo, peer, peer_rank, elo_rank, peer_rank - elo_rank AS rank_diff FROM vs"), tables=False)
def elo_vs_peer(s, d):
    return _elo_and_peer(s, d)


def _elo_correlation_sql() -> str:
    return fold_sql(VERSUS + RANKED.format("SELECT peer AS x, elo::double AS y FROM vs") + CORR)


@query(fold_sql(""), tables=False)
def elo_peer_correlation(s, d):
    return inference.correlation(_elo_and_peer(s, d).withColumn("elo", F.col("elo").cast("double")), "peer", "elo")


# inference
TAIL = "({k} * (0.254829592 + {k} * (-0.284496736 + {k} * (1.421413741 + {k} * (-1.453152027 + {k} * 1.061405429))))) * exp(-({t} * {t} / 2))"
HOME = """, hs AS (SELECT model, avg(score) FILTER (source_model = model) AS own, avg(score) FILTER (source_model <> model) AS other, var_samp(score) FILTER (source_model = model) AS v1, var_samp(score) FILTER (source_model <> model) AS v2,
  count(*) FILTER (source_model = model) AS n1, count(*) FILTER (source_model <> model) AS n2 FROM peer s JOIN f_questions q ON s.question = q.question GROUP BY 1),
ht AS (SELECT *, (own - other) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t, (own - other) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0) AS dd FROM hs WHERE n1 >= 3 AND n2 >= 3),
hk AS (SELECT *, 1.0 / (1.0 + 0.3275911 * abs(t) / 1.4142135623730951) AS k FROM ht),
hm AS (SELECT model, round(own, 4) AS own, round(other, 4) AS other, round(own - other, 4) AS diff, n1 AS n_own, n2 AS n_other, round(t, 4) AS t, round(""" + TAIL.format(k="k", t="t") + """, 6) AS p, round(dd, 4) AS d FROM hk)
"""


@query(HOME + "SELECT * FROM hm")
def home_advantage(s, d):
    return inference.home_advantage(fx.scores(s, d), fx.questions(s, d))


@query(HOME + "SELECT model, t, p, CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM hm")
def home_advantage_welch(s, d):
    return inference.home_advantage(fx.scores(s, d), fx.questions(s, d)).select("model", "t", "p", stats.stars(F.col("p")).alias("stars"))


@query(HOME + "SELECT model, d FROM hm")
def home_advantage_cohens_d(s, d):
    return inference.home_advantage(fx.scores(s, d), fx.questions(s, d)).select("model", "d")


@query(HOME + ", hc AS (SELECT *, coalesce(p > 0 AND p < 0.05, false) AS sure FROM hm) SELECT count(*) FILTER (sure AND diff > 0) AS positive, count(*) FILTER (sure AND diff < 0) AS negative, count(*) FILTER (NOT sure OR diff = 0) AS neither, round(avg(diff), 4) AS mean_diff FROM hc")
def home_advantage_summary(s, d):
    return inference.home_summary(inference.home_advantage(fx.scores(s, d), fx.questions(s, d)))


@query("SELECT source_model, round(avg(score), 4) AS mean, count(*) AS n FROM peer s JOIN f_questions q ON s.question = q.question GROUP BY 1")
def source_difficulty(s, d):
    return inference.source_difficulty(fx.scores(s, d), fx.questions(s, d))


def _named_models(s, d):
    return fx.models(s, d).withColumn("name", F.concat(F.lit("NATION_"), F.col("ordinal").cast("string")))


PROVIDER = ", pv AS (SELECT coalesce(m.provider, 'Other') AS provider, s.score FROM peer s LEFT JOIN f_models m ON s.model = concat('NATION_', m.ordinal::varchar))\n"


@query(PROVIDER + "SELECT provider, count(*) AS n, round(avg(score), 4) AS mean FROM pv GROUP BY 1")
def provider_means(s, d):
    return inference.provider_means(fx.scores(s, d), _named_models(s, d))


KRUSKAL = PROVIDER + """, rr AS (SELECT provider, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM pv), gg AS (SELECT provider, count(*)::double AS c, sum(rk)::double AS sr FROM rr GROUP BY 1 HAVING count(*) >= 2),
tt AS (SELECT sum(c::double * c * c - c) AS ties FROM (SELECT score, count(*) AS c FROM pv GROUP BY 1)), hh AS (SELECT sum(c) AS n, count(*) AS k, sum(sr * sr / c) AS ss FROM gg HAVING count(*) >= 2),
h2 AS (SELECT n, k, (12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / nullif(1 - ties / (n * n * n - n), 0) AS h FROM hh CROSS JOIN tt)
"""


@query(KRUSKAL + "SELECT round(h, 6) AS h, k - 1 AS df, n::bigint AS n, round(h / (n - 1), 8) AS eta2 FROM h2")
def provider_kruskal_h(s, d):
    return inference.kruskal(fx.scores(s, d), _named_models(s, d))


@query(KRUSKAL + """, h3 AS (SELECT round(h, 6) AS h, k - 1 AS df FROM h2)
SELECT h, df, round(1 - list_sum(list_transform(range(400), lambda j: exp((df / 2.0 + j) * ln(h / 2) - h / 2 - lgamma(df / 2.0 + j + 1)))), 8) AS p FROM h3""")
def provider_kruskal_p(s, d):
    k = inference.kruskal(fx.scores(s, d), _named_models(s, d))
    return k.select("h", "df", F.round(special.chi2_p("h", F.col("df").cast("double")), 8).alias("p"))


GP = ", gp AS (SELECT model, peer, given FROM (SELECT model, avg(score) AS peer FROM peer GROUP BY 1) a JOIN (SELECT evaluator AS model, avg(score) AS given FROM peer GROUP BY 1) b USING (model))\n"


@query(GP + "SELECT model, (rank() OVER (ORDER BY peer DESC) + (count(*) OVER (PARTITION BY peer) - 1) / 2.0)::double AS peer_rank, (rank() OVER (ORDER BY given DESC) + (count(*) OVER (PARTITION BY given) - 1) / 2.0)::double AS given_rank FROM gp")
def spearman_ranks(s, d):
    return inference.generosity_and_peer(fx.scores(s, d)).select("model", inference.mid_rank(F.col("peer")).cast("double").alias("peer_rank"), inference.mid_rank(F.col("given")).cast("double").alias("given_rank"))


CORR = f"""SELECT count(*) AS n, round({pearson_sql("x", "y")}, 6) AS pearson, round({pearson_sql("rx", "ry")}, 6) AS spearman, round((count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0), 6) AS slope,
  round((sum(y) - (count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0) * sum(x)) / count(*), 6) AS intercept FROM rk"""
RANKED = ", rk AS (SELECT *, rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y DESC) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ({}))\n"


ORACLE_SQL["elo_peer_correlation"] = _elo_correlation_sql()


@query(GP + RANKED.format("SELECT given AS x, peer AS y FROM gp") + CORR)
def generosity_vs_peer_ols(s, d):
    return inference.correlation(inference.generosity_and_peer(fx.scores(s, d)), "given", "peer")


# operations
@query("SELECT model, round(sum(seconds), 2) AS total, round(coalesce(avg(seconds) FILTER (seconds > 0), 0), 2) AS mean, count(*) AS n, count(*) FILTER (seconds > 0) AS ok FROM f_timings GROUP BY 1")
def timing_stats(s, d):
    return costs.timing(fx.timings(s, d))


@query("SELECT model, count(*) AS n FROM f_timings GROUP BY 1 HAVING count(*) FILTER (seconds > 0) = 0")
def failed_models(s, d):
    return costs.failed(fx.timings(s, d))


@query("SELECT model, count(*) AS n, min(q_ord) AS first FROM f_answers WHERE trim(text) = '' GROUP BY 1")
def refusals(s, d):
    return costs.refused(fx.answers(s, d)).groupBy("model").agg(F.count("*").alias("n"), F.min("q_ord").alias("first"))


COST = ", co AS (SELECT a.*, coalesce((a.in_tok * m.in_per_m + a.out_tok * m.out_per_m) / 1e6, 0) AS cost FROM f_answers a LEFT JOIN f_models m ON a.model_ord = m.ordinal)\n"


@query(COST + ", g AS (SELECT model, model_ord, sum(cost) AS c, count(*) AS calls, sum(in_tok)::bigint AS in_tok, sum(out_tok)::bigint AS out_tok FROM co GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY round(c, 4) DESC, model_ord) AS rank, model, round(c, 4) AS cost, calls, in_tok, out_tok, round(c / calls, 6) AS per_call FROM g")
def cost_per_model(s, d):
    return costs.cost_table(fx.answers(s, d), fx.models(s, d))


@query(COST + "SELECT CASE WHEN grouping(model) = 1 THEN 'TOTAL' ELSE model END AS model, round(sum(cost), 4) AS cost, count(*) AS calls FROM co GROUP BY ROLLUP (model)")
def cost_rollup(s, d):
    return costs.cost_rollup(fx.answers(s, d), fx.models(s, d))


@query(STATS + COST + ", g AS (SELECT model, model_ord, avg(cost) AS c FROM co GROUP BY 1, 2), e AS (SELECT g.model, g.model_ord, st.peer, c, round(coalesce(st.peer ** 2 / nullif(c * 100, 0), 0), 2) AS efficiency FROM st JOIN g USING (model) WHERE n > 0) SELECT row_number() OVER (ORDER BY efficiency DESC, model_ord) AS rank, model, round(peer, 4) AS peer, round(c * 100, 4) AS cents, efficiency FROM e")
def efficiency_rank(s, d):
    return costs.efficiency(scores.peer_stats(fx.scores(s, d)), fx.answers(s, d), fx.models(s, d))


@query("SELECT model, floor(avg(greatest(1, length(q.question) // 4) + 50))::bigint AS tokens FROM f_answers a JOIN f_questions q USING (q_ord) WHERE trim(text) <> '' GROUP BY 1")
def estimated_input_tokens(s, d):
    return costs.estimated_input(fx.answers(s, d), fx.questions(s, d))


@query("SELECT count(*) AS total, count(*) FILTER (NOT skipped) AS attempted, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, count(*) FILTER (skipped) AS skipped, round(sum(duration), 2) AS seconds, round(count(*) FILTER (NOT skipped) * 0.008::double, 4) AS cost FROM f_grounding")
def grounding_summary(s, d):
    return costs.searches(fx.grounding(s, d))


# extraction
CELL = """, cl AS (SELECT *, json_type(cell) AS kind, CASE WHEN json_type(cell) = 'OBJECT' THEN json_type(cell, '$.score') ELSE json_type(cell) END AS vk,
  CASE WHEN json_type(cell) = 'OBJECT' THEN cell ->> '$.score' ELSE cell ->> '$' END AS v FROM f_cells),
cn AS (SELECT *, CASE WHEN vk IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN v::double WHEN vk = 'BOOLEAN' THEN CASE v WHEN 'true' THEN 1 ELSE 0 END END::double AS num, CASE WHEN vk = 'VARCHAR' THEN trim(v) END AS str FROM cl)
"""
CELL_POLICIES = {
    "lenient": "CASE WHEN kind = 'OBJECT' THEN coalesce(num, CASE WHEN regexp_matches(str, '^[0-9.]*[0-9][0-9.]*$') THEN try_cast(str AS double) END) END",
    "elo": "CASE WHEN kind = 'OBJECT' THEN coalesce(num, CASE WHEN regexp_matches(str, '^[0-9]+$') THEN try_cast(str AS double) END) END",
    "strict": "num",
    "cast": "coalesce(num, try_cast(str AS double))",
}
for _k, _p in enumerate(("lenient", "elo", "strict", "cast"), 1):
    query(CELL + f"SELECT evaluator_ord, q_ord, model_ord, {CELL_POLICIES[_p]} AS score FROM cn", f"coerce_p{_k}")(lambda s, d, p=_p: fx.cells(s, d).select("evaluator_ord", "q_ord", "model_ord", coercion.POLICIES[p](F.col("cell")).alias("score")))


@query()
def extract_json(s, d):
    fence = F.concat(F.lit("Sure:\n```json\n"), F.col("cell"), F.lit("\n```\nDone."))
    said = F.when(F.col("q_ord") % 3 == 0, F.col("cell")).when(F.col("q_ord") % 3 == 1, fence).otherwise(F.concat(F.lit("I think {\"m\": "), F.col("cell"), F.lit("} is fair")))
    return fx.cells(s, d).select("evaluator_ord", "q_ord", "model_ord", text.extracted_json(said).cast("string").alias("json"))


LABELS = """, lb AS (SELECT *, row_number() OVER (PARTITION BY evaluator, question ORDER BY md5(concat_ws('|', '42', evaluator, question, model))) - 1 AS k FROM peer),
ll AS (SELECT evaluator, question, model, model_ord, concat('Response ', CASE WHEN k < 26 THEN chr((65 + k)::int) ELSE concat(chr((64 + k // 26)::int), chr((65 + k % 26)::int)) END) AS label FROM lb)
"""


def _labels(s, d):
    return sampling.blind_labels(scores.peer_cells(fx.scores(s, d)), ["evaluator", "question"], "model")


@query(LABELS + "SELECT evaluator, question, model, label FROM ll")
def blind_labels(s, d):
    return _labels(s, d).select("evaluator", "question", "model", "label")


@query(LABELS + ", gv AS (SELECT concat(evaluator, '/', question) AS grp, CASE model_ord % 3 WHEN 0 THEN label WHEN 1 THEN concat('the ', label, ' text') ELSE 'nothing' END AS given FROM ll), lx AS (SELECT concat(evaluator, '/', question) AS grp, label, model, model_ord FROM ll), jj AS (SELECT g.grp, g.given, l.model, row_number() OVER (PARTITION BY g.grp, g.given ORDER BY (g.given = l.label) DESC, l.model_ord) AS k FROM (SELECT DISTINCT * FROM gv WHERE given <> 'nothing') g JOIN lx l ON g.grp = l.grp AND (g.given = l.label OR contains(g.given, l.label) OR contains(l.label, g.given))) SELECT grp, given, model FROM jj WHERE k = 1")
def label_remap(s, d):
    rows = _labels(s, d).select(F.concat_ws("/", "evaluator", "question").alias("grp"), "label", "model", F.col("model_ord").alias("ordinal"))
    shape = F.col("ordinal") % 3
    given = rows.select("grp", F.when(shape == 0, F.col("label")).when(shape == 1, F.concat(F.lit("the "), F.col("label"), F.lit(" text"))).otherwise("nothing").alias("label")).distinct().where("label <> 'nothing'")
    return names.remapped(given, rows)


@query(", nm AS (SELECT DISTINCT CASE ordinal % 3 WHEN 0 THEN concat(' [', name, '] ') WHEN 1 THEN lower(substr(name, 1, 3)) ELSE concat(name, '?') END AS name FROM f_models), jn AS (SELECT nm.name, m.name AS model, row_number() OVER (PARTITION BY nm.name ORDER BY m.name <> regexp_replace(nm.name, '^[\\s\\[\\]]+|[\\s\\[\\]]+$', '', 'g'), m.ordinal) AS k FROM nm LEFT JOIN f_models m ON contains(lower(m.name), lower(regexp_replace(nm.name, '^[\\s\\[\\]]+|[\\s\\[\\]]+$', '', 'g')))) SELECT name, model FROM jn WHERE k = 1")
def fuzzy_name_match(s, d):
    m, k = fx.models(s, d), F.col("ordinal") % 3
    said = F.when(k == 0, F.concat(F.lit(" ["), F.col("name"), F.lit("] "))).when(k == 1, F.lower(F.substring("name", 1, 3))).otherwise(F.concat(F.col("name"), F.lit("?")))
    return names.matched(m.select(said.alias("name")), m)


def num_sql(x: str) -> str:
    return f"try_cast(regexp_replace(trim({x}), '[,$]', '', 'g') AS double)"


def last_sql(p: str) -> str:
    return "regexp_extract_all(text, '{}', 1)[-1]".format(p.replace("'", "''"))


@query(f"SELECT q_ord, model, {num_sql(last_sql(text.GOLD))} AS gold FROM f_answers")
def extract_gold(s, d):
    return fx.answers(s, d).select("q_ord", "model", text.gold_answer(F.col("text")).alias("gold"))


EXTRACTED = f", ex AS (SELECT *, {num_sql('coalesce(' + ', '.join(last_sql(p) for p in text.ANSWERS) + ')')} AS extracted FROM f_answers)\n"


@query(EXTRACTED + "SELECT q_ord, model, extracted FROM ex")
def extract_model_answer(s, d):
    return fx.answers(s, d).select("q_ord", "model", text.model_answer(F.col("text")).alias("extracted"))


REPLIES = ["B", "The answer is C.", "answer: d", "I pick (A)", "", "because none fit", "Choice A is right", "C\nfor it holds", "**B**", "so it must be D."]
REPLY = ", rp AS (SELECT q_ord, (" + repr(REPLIES).replace("\\n", "\n") + ")[q_ord % 10 + 1] AS text FROM f_questions)\n"


def _replies(s, d):
    return fx.questions(s, d).select("q_ord", F.get(F.array(*map(F.lit, REPLIES)), F.col("q_ord") % 10).alias("text"))


@query(REPLY + "SELECT q_ord, coalesce(nullif(regexp_extract(upper(text), '([A-E])', 1), ''), '?') AS letter FROM rp")
def mc_letter_tfq(s, d):
    return _replies(s, d).select("q_ord", text.choice_letter(F.col("text"), "A-E").alias("letter"))


@query(REPLY + ", up AS (SELECT q_ord, upper(trim(text)) AS t, trim(split_part(upper(trim(text)), chr(10), 1)) AS l FROM rp) SELECT q_ord, coalesce(CASE WHEN length(l) <= 2 THEN nullif(regexp_extract(l, '^([A-D])', 1), '') END, CASE WHEN length(t) <= 3 THEN nullif(regexp_extract(t, '([A-D])', 1), '') END, nullif(regexp_extract(t, '\\b([A-D])\\s*\\.?\\s*$', 1), ''), nullif(regexp_extract(t, '(?:ANSWER|CHOICE)[:\\s]+([A-D])\\b', 1), ''), nullif(regexp_extract(t, '([A-D])', 1), ''), '?') AS letter FROM up")
def mc_letter_mmlu(s, d):
    return _replies(s, d).select("q_ord", text.letter_cascade(F.col("text")).alias("letter"))


STEPS = ", sp AS (SELECT doc_id, greatest(1, len(list_filter(string_split(lower(text), chr(10)), lambda x: " + " OR ".join(f"contains(x, '{m}')" for m in text.STEP_MARKS) + ")))::int AS steps FROM documents)\n"


@query(STEPS + "SELECT doc_id, steps FROM sp")
def solution_steps(s, d):
    return fx.read(s, d, "documents").select("doc_id", text.solution_steps(F.col("text")).alias("steps"))


@query(STEPS + "SELECT CASE WHEN steps <= 3 THEN 'easy' WHEN steps <= 5 THEN 'medium' ELSE 'hard' END AS difficulty, count(*) AS n FROM sp GROUP BY 1")
def difficulty_buckets(s, d):
    return fx.read(s, d, "documents").groupBy(text.difficulty(text.solution_steps(F.col("text"))).alias("difficulty")).agg(F.count("*").alias("n"))


TYPOGRAPHIC = ", tg AS (SELECT conv_id, turn, concat('“', text, '” – it’s…') AS text FROM conversations)\n"


@query(TYPOGRAPHIC + "SELECT conv_id, turn, replace(translate(text, '‘’“”–— ', '''''\"\"-- '), '…', '...') AS text FROM tg")
def sanitize_text(s, d):
    t = F.concat(F.lit("“"), F.col("text"), F.lit("” – it’s…"))
    return fx.read(s, d, "conversations").select("conv_id", "turn", text.sanitized(t).alias("text"))


@query("SELECT conv_id, turn, regexp_replace(concat('<think>a', chr(10), 'b</think> ', text), '(?s)<think>.*?</think>\\s*', '', 'g') AS text FROM conversations")
def strip_think_tags(s, d):
    return fx.read(s, d, "conversations").select("conv_id", "turn", text.without_thoughts(F.concat(F.lit("<think>a\nb</think> "), F.col("text"))).alias("text"))


@query("SELECT model, round(sum(seconds), 1) AS total, CASE WHEN sum(seconds) < 60 THEN 'short' ELSE 'long' END AS kind FROM f_timings GROUP BY 1")
def runtimes(s, d):
    return fx.timings(s, d).groupBy("model").agg(F.round(F.sum("seconds"), 1).alias("total"), F.when(F.sum("seconds") < 60, "short").otherwise("long").alias("kind"))


# validation
GRADED = EXTRACTED + """, gr AS (SELECT e.*, g.gold_num, coalesce(abs(extracted - gold_num) < 1e-6, false) AS correct FROM ex e JOIN f_gold g USING (q_ord) WHERE gold_num IS NOT NULL),
ac AS (SELECT model, model_ord, count(*) FILTER (correct) AS correct, count(*) AS total, round(count(*) FILTER (correct) * 100.0::double / count(*), 1) AS accuracy, round(count(*) FILTER (correct) * 10.0::double / count(*), 2) AS mean FROM gr GROUP BY 1, 2)
"""
COMPARED = GRADED + """, pe AS (SELECT model, model_ord, avg(score) AS peer FROM peer GROUP BY 1, 2), cp AS (SELECT model, pe.model_ord, peer, mean AS truth, accuracy, row_number() OVER (ORDER BY peer DESC, pe.model_ord) AS peer_rank, (rank() OVER (ORDER BY mean DESC) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0)::double AS truth_rank FROM pe JOIN ac USING (model) WHERE mean > 0)
"""


def _accuracy(s, d):
    return benchmark.accuracy(benchmark.graded(fx.answers(s, d), fx.gold(s, d)))


def _compared(s, d):
    return benchmark.comparison(fx.scores(s, d), _accuracy(s, d))


@query(GRADED + "SELECT model, correct, total, accuracy, mean FROM ac")
def accuracy_summary(s, d):
    return _accuracy(s, d).drop("model_ord")


Z = stats.Z95


@query(GRADED + f", w AS (SELECT model, correct, total, total::double AS n, correct::double / total AS p FROM ac) SELECT model, correct, total, round(greatest(0, ((p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n)) - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)) / (1 + {Z} * {Z} / n)), 4) AS low, round(least(1, ((p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n)) + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4 * n * n)) / (1 + {Z} * {Z} / n)), 4) AS high FROM w")
def wilson_ci(s, d):
    return benchmark.accuracy_intervals(_accuracy(s, d))


PT = COMPARED + RANKED.format("SELECT peer AS x, truth AS y FROM cp")


@query(PT + f", co AS ({CORR}) SELECT n, pearson, round(CASE WHEN n < 4 OR abs(pearson) >= 1 THEN pearson ELSE tanh(atanh(pearson) - {Z} / sqrt(n - 3)) END, 4) AS low, round(CASE WHEN n < 4 OR abs(pearson) >= 1 THEN pearson ELSE tanh(atanh(pearson) + {Z} / sqrt(n - 3)) END, 4) AS high FROM co")
def fisher_ci(s, d):
    return benchmark.correlated_with_ci(_compared(s, d))


@query(STATS + f""", cr AS (SELECT df, list_reduce(list_transform(range(120), lambda x: [0.0, 1000000.0]::double[]), lambda a, b: CASE WHEN {t_two_sided_sql("((a[1] + a[2]) / 2)", "df")} > 0.05 THEN [(a[1] + a[2]) / 2, a[2]] ELSE [a[1], (a[1] + a[2]) / 2] END) AS ends FROM (SELECT DISTINCT greatest(n - 1, 1) AS df FROM st) x),
hw AS (SELECT model, peer, CASE WHEN n > 1 THEN (ends[1] + ends[2]) / 2 * sd / sqrt(n) ELSE 0 END AS half FROM st JOIN cr ON df = greatest(n - 1, 1) WHERE n > 0) SELECT model, round(peer - half, 2) AS low, round(peer + half, 2) AS high FROM hw""")
def t_ci(s, d):
    return benchmark.score_intervals(fx.scores(s, d))


@query(COMPARED + "SELECT model, round(peer, 4) AS peer, truth, peer_rank, truth_rank, peer_rank - truth_rank AS rank_diff FROM cp")
def peer_truth_comparison(s, d):
    return benchmark.shown(_compared(s, d))


@query(COMPARED + "SELECT arg_min(model, (rank_diff, model_ord)) AS over_rated, min(rank_diff)::double AS over_diff, arg_min(model, (-rank_diff, model_ord)) AS under_rated, max(rank_diff)::double AS under_diff FROM (SELECT *, peer_rank - truth_rank AS rank_diff FROM cp)")
def over_and_under_rated(s, d):
    return benchmark.misjudged(_compared(s, d))


@query(PT + f", co AS ({CORR}) SELECT n, pearson, round(pearson * pearson, 6) AS r2 FROM co")
def explained_variance(s, d):
    return benchmark.fit_quality(_compared(s, d)).drop("conclusion")


@query(PT + f""", co AS ({CORR}), cl AS (SELECT n, pearson, {pearson_p_sql("pearson", "n")} AS p, (SELECT count(DISTINCT truth) FROM cp) AS truths FROM co)
SELECT n, pearson, round(pearson * pearson, 6) AS r2, CASE WHEN pearson >= 0.7 AND p < 0.05 THEN 'strongly correlates' WHEN pearson >= 0.5 AND p < 0.05 THEN 'moderate correlation' WHEN truths = 1 THEN 'cannot determine' ELSE 'weak/no correlation' END AS conclusion FROM cl""")
def validation_conclusion(s, d):
    return benchmark.fit_quality(_compared(s, d))


@query(MATCHES + "SELECT mode, model_ord, concat_ws('-', wins, losses, ties) AS tally FROM wl")
def elo_tally_text(s, d):
    return elo.tallies(elo.matches(fx.scores(s, d))).select("mode", "model_ord", F.concat_ws("-", "wins", "losses", "ties").alias("tally"))


@query(PT + f", co AS ({CORR}) SELECT n, pearson, spearman, CASE WHEN abs(pearson) >= 0.8 THEN 'strong' WHEN abs(pearson) >= 0.6 THEN 'moderate' WHEN abs(pearson) >= 0.4 THEN 'weak' ELSE 'very weak' END AS strength FROM co")
def peer_truth_correlation(s, d):
    return benchmark.correlated(_compared(s, d))


@query(PT + f""", co AS ({CORR}) SELECT n, pearson, round({pearson_p_sql("pearson", "n")}, 8) AS pearson_p, spearman, round({pearson_p_sql("spearman", "n")}, 8) AS spearman_p FROM co""")
def pearson_p(s, d):
    p = benchmark.correlated_with_p(_compared(s, d))
    return p.select("n", "pearson", F.round("pearson_p", 8).alias("pearson_p"), "spearman", F.round("spearman_p", 8).alias("spearman_p"))


@query(COMPARED + "SELECT model, truth, truth_rank FROM cp")
def truth_ranks_with_ties(s, d):
    return _compared(s, d).select("model", "truth", F.col("truth_rank").cast("double").alias("truth_rank"))


@query(COMPARED + ", df AS (SELECT *, abs(peer_rank - truth_rank) AS x FROM cp) SELECT count(*) AS n, count(*) FILTER (x < 0.5) AS exact, count(*) FILTER (x <= 1.5) AS within_1, round(avg(x), 4) AS mean_diff, max(x) AS max_diff, round(avg(accuracy), 4) AS mean_accuracy, round(stddev_pop(accuracy), 4) AS sd_accuracy, round(max(accuracy) - min(accuracy), 4) AS range_accuracy FROM df")
def rank_agreement_summary(s, d):
    return benchmark.rank_agreement(_compared(s, d))


@query(STATS + GRADED + f""", sl AS (SELECT peer, self, mean AS truth FROM st JOIN ac USING (model) WHERE n_self > 0 AND n > 0 AND mean > 0), r1 AS (SELECT *, rank() OVER (ORDER BY peer DESC) + (count(*) OVER (PARTITION BY peer) - 1) / 2.0 AS rp, rank() OVER (ORDER BY self DESC) + (count(*) OVER (PARTITION BY self) - 1) / 2.0 AS rs, rank() OVER (ORDER BY truth DESC) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0 AS rt FROM sl),
ab AS (SELECT count(*) AS n, round({pearson_sql("peer", "truth")}, 6) AS peer_r, round({pearson_sql("self", "truth")}, 6) AS self_r, round({pearson_sql("rp", "rt")}, 6) AS peer_rho, round({pearson_sql("rs", "rt")}, 6) AS self_rho FROM r1)
SELECT *, round(peer_r - self_r, 6) AS gain_r, round(peer_rho - self_rho, 6) AS gain_rho FROM ab WHERE n >= 3 AND (self_r <> 0 OR self_rho <> 0)""")
def ablation_peer_vs_self(s, d):
    return benchmark.ablation(fx.scores(s, d), _accuracy(s, d))


@query(", g AS (SELECT model, avg(out_tok) AS t, avg(length(text)) AS c FROM f_answers GROUP BY 1) SELECT model, round(t, 4) AS mean_tokens, round(c, 4) AS mean_chars, round(CASE WHEN t > 0 THEN c / t ELSE 0 END, 6) AS ratio, CASE WHEN (CASE WHEN t > 0 THEN c / t ELSE 0 END) < 0.6 THEN 'Internal CoT' WHEN (CASE WHEN t > 0 THEN c / t ELSE 0 END) < 1.0 THEN 'Thinking tokens' ELSE 'Standard' END AS label FROM g")
def reasoning_mode(s, d):
    return benchmark.reasoning_modes(fx.answers(s, d))


DIFFICULTY = "CASE q_ord % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END"


@query(GRADED + f"SELECT model, {DIFFICULTY} AS difficulty, count(*) FILTER (NOT correct) AS errors, count(*) AS total, round(count(*) FILTER (NOT correct) * 100.0::double / count(*), 4) AS rate FROM gr GROUP BY 1, 2")
def error_rate_by_difficulty(s, d):
    rows = benchmark.graded(fx.answers(s, d), fx.gold(s, d)).withColumn("difficulty", F.expr(DIFFICULTY))
    return benchmark.errors_by_difficulty(rows)


# sampling
WATER = """, av AS (SELECT category, count(*) AS available FROM f_questions GROUP BY 1), lv AS (SELECT l, sum(least(available, l)) AS got FROM av, range(0, 101) r(l) GROUP BY 1), fl AS (SELECT max(l) AS l FROM lv WHERE got <= 60),
b0 AS (SELECT category, available, least(available, l) AS base, row_number() OVER (PARTITION BY available > l ORDER BY category) AS k, available > l AS open FROM av, fl), qt AS (SELECT category, available, (base + CASE WHEN open AND k <= 60 - (SELECT sum(base) FROM b0) THEN 1 ELSE 0 END)::bigint AS taken FROM b0)
"""


@query(WATER + "SELECT category, available, taken FROM qt")
def stratified_quota(s, d):
    return sampling.quota_table(fx.questions(s, d), "category", 60)


SAMPLE = ", sm AS (SELECT question, q.category, row_number() OVER (PARTITION BY q.category ORDER BY md5(concat_ws('|', '42', question))) AS k FROM f_questions q)\n"


@query(WATER + SAMPLE + "SELECT sm.category, question FROM sm JOIN qt ON sm.category = qt.category WHERE k <= taken")
def stratified_sample(s, d):
    return sampling.stratified(fx.questions(s, d), "category", "question", 60).select("category", "question")


EVEN = ", ev AS (SELECT category, least(count(*), 8 + CASE WHEN row_number() OVER (ORDER BY category) <= 3 THEN 1 ELSE 0 END)::bigint AS taken FROM f_questions GROUP BY 1)\n"


@query(EVEN + SAMPLE + "SELECT sm.category, question FROM sm JOIN ev ON sm.category = ev.category WHERE k <= taken")
def even_sample(s, d):
    return sampling.stratified(fx.questions(s, d), "category", "question", 43, even=True).select("category", "question")


@query(SAMPLE + ", st3 AS (SELECT category FROM (SELECT DISTINCT category FROM f_questions) ORDER BY md5('42|' || category) LIMIT 3) SELECT category, question FROM sm WHERE k = 1 AND category IN (SELECT category FROM st3)")
def spread_sample(s, d):
    return sampling.spread(fx.questions(s, d), "category", "question", 3).select("category", "question")


@query(", ch AS (SELECT q_ord, ['right', 'wrong one', 'wrong two', 'wrong three'] AS c FROM f_questions), un AS (SELECT q_ord, unnest(c) AS x FROM ch), od AS (SELECT q_ord, list(x ORDER BY md5(concat_ws('|', '42', q_ord::varchar, x))) AS o FROM un GROUP BY 1) SELECT q_ord, array_to_string(o, '/') AS choices, chr((64 + list_position(o, 'right'))::int) AS letter FROM od")
def shuffled_choices(s, d):
    c = F.array(*map(F.lit, ["right", "wrong one", "wrong two", "wrong three"]))
    order, letter = sampling.shuffled_choices(c, F.col("q_ord").cast("string"))
    return fx.questions(s, d).select("q_ord", F.array_join(order, "/").alias("choices"), letter.alias("letter"))


# rules
RULE_ROWS = fx.SUBJECT_SQL + ", rx AS (SELECT *, lower(concat_ws(' ', question, array_to_string(choices, ' '))) AS x, array_to_string(choices, ' ') AS cs FROM f_subject)\n"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def re_sql(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q('(?i)' + p)})"


PURE = "coalesce(" + ", ".join(f"CASE WHEN {re_sql('x', p)} AND ({'true' if 'incline' in p or 'kinematics' in v or 'fire hose' in v else 'false'} OR regexp_matches(cs, {q(rules.UNITS)}) OR len(list_filter(choices, lambda c: NOT (regexp_matches(trim(c), {q(rules.PLAIN_ANSWER)}) OR regexp_matches(lower(trim(c)), '^a\\s*=\\s*g')))) = 0) THEN {q(v)} END" for p, v in rules.PHYSICS) + ")"


@query(RULE_ROWS + f", fd AS (SELECT *, {PURE} AS description FROM rx), f2 AS (SELECT *, CASE WHEN description IS NOT NULL THEN 'PHYSICS' WHEN subject = 'college_medicine' AND ({' OR '.join(f'regexp_matches(x, {q(p)})' for p in rules.MCAT)}) AND NOT regexp_matches(x, {q(rules.MEDICAL_SHORT)}) THEN 'PHYSICS (MCAT-style)' END AS finding FROM fd) SELECT q_ord, subject, finding, description FROM f2 WHERE finding IS NOT NULL")
def rule_findings(s, d):
    return rules.findings(fx.subject_questions(s, d)).select("q_ord", "subject", "finding", "description")


@query(RULE_ROWS + ", ri AS (SELECT *, coalesce(" + ", ".join(f"CASE WHEN {re_sql('x', p)} THEN {q(v)} END" for p, v in rules.INDICATORS) + f") AS indicator FROM rx WHERE NOT {re_sql('x', rules.MEDICAL)}) SELECT q_ord, subject, indicator FROM ri WHERE indicator IS NOT NULL")
def rule_first_match(s, d):
    return rules.indicators(fx.subject_questions(s, d)).select("q_ord", "subject", "indicator")


@query(RULE_ROWS + "SELECT q_ord, question FROM rx WHERE NOT (" + " OR ".join(f"contains(x, {q(t.lower())})" for t in rules.TERMS) + ")")
def rule_no_term(s, d):
    return rules.without_terms(fx.subject_questions(s, d)).select("q_ord", "question")


CLASSED = RULE_ROWS + ", kc AS (SELECT *, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(x, {q(k)})' for k in ks)} THEN {q(n)}" for n, ks in rules.CLASSES) + " ELSE 'OTHER' END AS class FROM rx)\n"


@query(CLASSED + "SELECT q_ord, class FROM kc")
def keyword_category(s, d):
    return rules.classified(fx.subject_questions(s, d)).select("q_ord", "class")


@query(CLASSED + ", kk AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY q_ord) AS k FROM kc) SELECT class, count(*) AS n, round(count(*) * 100.0::double / (SELECT count(*) FROM kc), 2) AS percent, string_agg(q_ord::varchar, ',' ORDER BY q_ord) FILTER (k <= 3) AS examples, greatest(0, count(*) - 3)::bigint AS more FROM kk GROUP BY 1")
def class_report(s, d):
    return rules.report(rules.classified(fx.subject_questions(s, d)), "class")


@query(RULE_ROWS + ", tp AS (SELECT coalesce(" + ", ".join(f"CASE WHEN {re_sql('x', '|'.join(f'(?:{p})' for p in ps))} THEN {q(n)} END" for n, ps in rules.TOPICS) + f") AS topic FROM rx WHERE subject = 'college_medicine' AND NOT {re_sql('x', rules.MEDICAL)}) SELECT topic, count(*) AS n FROM tp WHERE topic IS NOT NULL GROUP BY 1")
def topic_counts(s, d):
    return rules.topics(fx.subject_questions(s, d)).groupBy("topic").agg(F.count("*").alias("n"))


# dimensions and work
SUBJECT = fx.SUBJECT_SQL + ", sg AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{x}')" for g, xs in catalog.SUBJECT_GROUPS.items() for x in xs) + ") v(grp, subject))\n"


@query(SUBJECT + "SELECT grp, count(*) AS n, count(DISTINCT subject) AS subjects FROM f_subject JOIN sg USING (subject) GROUP BY 1")
def subject_group_counts(s, d):
    j = fx.subject_questions(s, d).join(catalog.subject_groups(s), "subject")
    return j.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query(SUBJECT + "SELECT q_ord, subject FROM f_subject SEMI JOIN (SELECT subject FROM sg WHERE lower(grp) = 'medical') g USING (subject)")
def subject_subset(s, d):
    return catalog.of_group(fx.subject_questions(s, d), "Medical").select("q_ord", "subject")


TRUTHFUL = ["Statistics", "Proverbs", "Health", "Politics", "History", "Confusion: Other", "Law"]


@query(fx.SUBJECT_SQL + f", tc AS (SELECT q_ord, ({TRUTHFUL!r})[length(question) % 7 + 1] AS own FROM f_subject) SELECT q_ord, CASE " + " ".join(f"WHEN own = {x!r} THEN '{n}'" for x, n in catalog.CATEGORY_MAP.items()) + f" ELSE '{catalog.DEFAULT_CATEGORY}' END AS category FROM tc")
def mapped_categories(s, d):
    own = F.get(F.array(*map(F.lit, TRUTHFUL)), F.length("question") % 7)
    return fx.subject_questions(s, d).select("q_ord", catalog.mapped_category(own).alias("category"))


@query("SELECT q_ord, CASE WHEN q_ord % 3 = 0 THEN 0 ELSE 1 END::int AS correct_index FROM f_questions WHERE q_ord % 3 <> 2")
def valid_choice_rows(s, d):
    o = F.col("q_ord") % 3
    labels = F.when(o == 0, F.array(F.lit(1), F.lit(0))).when(o == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))
    rows = fx.questions(s, d).select("q_ord", F.array(F.lit("a"), F.lit("b")).alias("choices"), labels.alias("labels"))
    return catalog.valid_choices(rows).select("q_ord", "correct_index")


@query("SELECT mode, name AS evaluator, question FROM f_questions CROSS JOIN f_models CROSS JOIN (VALUES ('shuffle_only'), ('blind_only'), ('shuffle_blind')) v(mode)")
def evaluation_tasks(s, d):
    t = catalog.evaluation_tasks(fx.models(s, d).select(F.col("name").alias("evaluator")), fx.questions(s, d).select("question"), ["shuffle_only", "blind_only", "shuffle_blind"])
    return t.select("mode", "evaluator", "question")


@query("SELECT q_ord, count(*) AS models, sum(out_tok)::bigint AS out_tok FROM f_answers GROUP BY 1")
def nested_answers(s, d):
    n = catalog.nested_answers(fx.answers(s, d))
    total = F.aggregate(F.map_values("answers"), F.lit(0).cast("long"), lambda t, a: t + a["out_tok"])
    return n.select("q_ord", F.size("answers").cast("long").alias("models"), total.alias("out_tok"))


@query("SELECT ordinal, name FROM f_models WHERE lower(name) = (SELECT lower(min(name)) FROM f_models)")
def judge_lookup(s, d):
    m = fx.models(s, d)
    return m.join(F.broadcast(m.agg(F.lower(F.min("name")).alias("k"))), F.lower("name") == F.col("k")).select("ordinal", "name")


@query("SELECT q_ord, concat('A. ', question, chr(10), 'B. ', category) AS block FROM f_questions")
def choice_blocks(s, d):
    return fx.questions(s, d).select("q_ord", prompts.choices_block(F.array("question", "category")).alias("block"))


@query(LABELS + "SELECT evaluator, question, count(*) AS n, string_agg('--- ' || label || ' ---' || chr(10) || model, chr(10) || chr(10) ORDER BY label) AS block FROM ll GROUP BY 1, 2")
def response_blocks(s, d):
    g = _labels(s, d).groupBy("evaluator", "question").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("label", F.col("model").alias("text")))).alias("r"))
    return g.select("evaluator", "question", "n", prompts.responses_block(F.col("r")).alias("block"))


@query(GRADED + f", er AS (SELECT model, {DIFFICULTY} AS difficulty, count(*) FILTER (NOT correct) * 100.0::double / count(*) AS rate FROM gr GROUP BY 1, 2), rm AS (SELECT model, CASE WHEN avg(length(text)) / nullif(avg(out_tok), 0) < 0.00008 THEN 'CoT' ELSE 'Standard' END AS kind FROM f_answers GROUP BY 1) SELECT kind, count(*) AS models, round(avg(rate), 4) AS hard_rate FROM er JOIN rm USING (model) WHERE difficulty = 'hard' GROUP BY 1")
def hard_error_rate(s, d):
    rows = benchmark.graded(fx.answers(s, d), fx.gold(s, d)).withColumn("difficulty", F.expr(DIFFICULTY))
    rates = rows.where("difficulty = 'hard'").groupBy("model").agg((F.count_if(~F.col("correct")) * 100.0 / F.count("*")).alias("rate"))
    kinds = fx.answers(s, d).groupBy("model").agg(F.when(F.avg(F.length("text")) / F.nullif(F.avg("out_tok"), F.lit(0)) < 0.00008, "CoT").otherwise("Standard").alias("kind"))
    return rates.join(kinds, "model").groupBy("kind").agg(F.count("*").alias("models"), F.round(F.avg("rate"), 4).alias("hard_rate"))


@query("SELECT category, count(*) AS n FROM f_questions WHERE contains(lower(category), 'high') OR contains(lower(category), 'low') GROUP BY 1")
def category_filter(s, d):
    from .sources.json_files import active_categories

    return active_categories(fx.questions(s, d), include=["HIGH", "low"]).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT name, CASE name WHEN 'NATION_1' THEN 0.2 ELSE 0.7 END::double AS temperature FROM f_models")
def model_temperatures(s, d):
    return catalog.temperatures(fx.models(s, d), {"NATION_1": 0.2}, 0.7)


@query("SELECT mode, count(*) AS done, concat('[', repeat('#', (count(*) * 20 // (12 * 12 * 100))::int), repeat('-', (20 - count(*) * 20 // (12 * 12 * 100))::int), '] ', count(*)::varchar, '/14400 (', (count(*) * 100 // 14400)::varchar, '%)') AS bar FROM f_scores GROUP BY 1")
def progress_bars(s, d):
    g = fx.scores(s, d).groupBy("mode").agg(F.count("*").alias("done"))
    return g.select("mode", "done", catalog.progress(F.col("done"), F.lit(14400).cast("long"), 20).alias("bar"))


# runs
@query("SELECT evaluator, question, model FROM f_scores WHERE mode = 'shuffle_blind' AND NOT EXISTS (SELECT 1 FROM f_scores b WHERE b.mode = 'blind_only' AND b.evaluator = f_scores.evaluator AND b.question = f_scores.question AND b.model = f_scores.model)")
def resume_anti_join(s, d):
    c = fx.scores(s, d)
    keys = ["evaluator", "question", "model"]
    return incremental.to_do(c.where("mode = 'shuffle_blind'").select(*keys), c.where("mode = 'blind_only'"), keys)


@query("SELECT mode FROM f_scores EXCEPT SELECT mode FROM f_scores WHERE mode = 'shuffle_only'")
def remaining_modes_except(s, d):
    c = fx.scores(s, d)
    return incremental.remaining(c.select("mode").distinct(), c.where("mode = 'shuffle_only'"))


@query("SELECT model FROM f_scores INTERSECT SELECT model FROM f_answers WHERE num > 10")
def common_models_intersect(s, d):
    return incremental.common(fx.scores(s, d), fx.answers(s, d).where("num > 10"))


@query("SELECT model, score FROM f_scores WHERE mode = 'blind_only' UNION ALL SELECT model, score FROM f_scores WHERE mode = 'shuffle_only'")
def merge_union(s, d):
    c = fx.scores(s, d).select("mode", "model", "score")
    return incremental.merged(c.where("mode = 'blind_only'").drop("mode"), c.where("mode = 'shuffle_only'").drop("mode"))


# figures
TIMES = ", tm AS (SELECT model, round(coalesce(avg(seconds) FILTER (seconds > 0), 0), 2) AS t FROM f_timings GROUP BY 1)\n"


@query(STATS + TIMES + ", j AS (SELECT model, peer, t FROM st JOIN tm USING (model) WHERE n > 0) SELECT model, round(peer, 4) AS peer, t AS seconds, round((SELECT median(peer) FROM j), 4) AS mid_peer, round((SELECT median(t) FROM j), 4) AS mid_seconds FROM j")
def score_vs_time(s, d):
    return views.score_and_time(fx.scores(s, d), fx.timings(s, d))


def clamp_sql(x: str) -> str:
    return f"round(greatest(0, least(1, {x})), 4)"


@query(STATS + TIMES + ", gv AS (SELECT evaluator AS model, avg(score) AS given FROM peer GROUP BY 1), j AS (SELECT * FROM st JOIN tm USING (model) JOIN gv USING (model) WHERE n > 0) SELECT model, " + f"{clamp_sql('peer / 10')} AS score, {clamp_sql('1 - coalesce(sd / nullif(max(sd) OVER (), 0), 0)')} AS steadiness, {clamp_sql('1 - coalesce(t / nullif(max(t) OVER (), 0), 0)')} AS speed, {clamp_sql('0.5 - (self - peer) / 4')} AS humility, {clamp_sql('1 - (given - 5) / 5')} AS rigour FROM j")
def radar_metrics(s, d):
    return views.radar(fx.scores(s, d), fx.timings(s, d))


@query(PT + f", co AS ({CORR}) SELECT n, slope, intercept FROM co")
def trend_line(s, d):
    return inference.correlation(_compared(s, d), "peer", "truth").select("n", "slope", "intercept")


@query(", h AS (SELECT name, (ordinal::bigint * 1398101) % 16777216 AS v FROM f_models), c AS (SELECT name, concat('#', lpad(upper(to_hex(v)), 6, '0')) AS background, (v // 65536) / 255.0 AS r, (v // 256 % 256) / 255.0 AS g, (v % 256) / 255.0 AS b FROM h) SELECT name, background, CASE WHEN 0.2126 * CASE WHEN r <= 0.03928 THEN r / 12.92 ELSE ((r + 0.055) / 1.055) ** 2.4 END + 0.7152 * CASE WHEN g <= 0.03928 THEN g / 12.92 ELSE ((g + 0.055) / 1.055) ** 2.4 END + 0.0722 * CASE WHEN b <= 0.03928 THEN b / 12.92 ELSE ((b + 0.055) / 1.055) ** 2.4 END < 0.5 THEN 'white' ELSE 'black' END AS text FROM c")
def text_colour_wcag(s, d):
    return views.text_colours(fx.models(s, d))


# single questions
def results_sql(mode: str) -> str:
    return f"""SELECT question, model, model_ord, nullif(avg(score) FILTER (evaluator <> model), 0) AS peer, max(score) FILTER (evaluator = model) AS self
  FROM (SELECT DISTINCT question FROM f_scores WHERE mode = '{mode}') CROSS JOIN roster LEFT JOIN (SELECT question, model, evaluator, score FROM f_scores WHERE mode = '{mode}') USING (question, model) GROUP BY 1, 2, 3"""


RANKED = "row_number() OVER (PARTITION BY question ORDER BY coalesce({0}, 0) DESC, model_ord) AS rank"
MODELS = [f"NATION_{k}" for k in range(fx.N_MODELS)]


@query(ROSTER + f", g AS ({results_sql('shuffle_blind')}) SELECT question, {RANKED.format('peer')}, model, round(peer, 4) AS peer, self, round(self - peer, 4) AS self_bias FROM g")
def question_results(s, d):
    return single.question_results(fx.scores(s, d), MODELS)


@query(ROSTER + f", g AS ({results_sql('shuffle_only')}), b AS ({results_sql('shuffle_blind')}) SELECT question, {RANKED.format('g.peer').replace('model_ord', 'g.model_ord')}, model, round(g.peer, 4) AS score, round(b.peer - g.peer, 4) AS name_bias FROM g LEFT JOIN b USING (question, model)")
def question_name_bias(s, d):
    return single.question_name_bias(fx.scores(s, d), MODELS)


@query(", p AS (SELECT name, ['google', 'openai', 'anthropic', 'deepseek', 'xai'][ordinal % 5 + 1] AS provider, concat(lower(name), ['-mini', '-thinking', '-nano', ''][ordinal % 4 + 1]) AS model_id FROM f_models) SELECT name, CASE WHEN provider = 'google' AND model_id LIKE '%thinking%' THEN 'thinking: OFF (disabled)' WHEN provider = 'anthropic' THEN 'extended thinking: OFF' WHEN provider = 'deepseek' OR provider = 'openai' AND (model_id LIKE '%nano%' OR model_id LIKE '%mini%') THEN 'reasoning: default (may use internal CoT)' ELSE 'standard' END AS label FROM p")
def reasoning_labels(s, d):
    of = lambda *values: F.get(F.array(*map(F.lit, values)), F.col("ordinal") % len(values))
    m = fx.models(s, d)
    return m.select("name", catalog.reasoning_label(of("google", "openai", "anthropic", "deepseek", "xai"), F.concat(F.lower("name"), of("-mini", "-thinking", "-nano", ""))).alias("label"))


@query("SELECT model, translate(CASE WHEN peer = 2 THEN '2' ELSE peer::varchar END, '0123456789.', '⁰¹²³⁴⁵⁶⁷⁸⁹·') AS shown FROM (SELECT model, round(avg(score), 1) AS peer FROM peer GROUP BY 1)")
def raised_digits(s, d):
    peer = fx.scores(s, d).where("mode = 'shuffle_blind' AND evaluator <> model").groupBy("model").agg(F.round(F.avg("score"), 1).alias("peer"))
    return peer.select("model", text.exponent(F.col("peer")).alias("shown"))


# the phases that ask models
def phase_answers(s, d):
    """Answers to every user turn after searches, and the searches."""
    asked_of = fx.talk_questions(s, d)
    found = phases.fetched(asked_of, fx.Canned, "search", 0.008)
    at = folders.scratch(s, "searches")
    found.write.parquet(at)  # or each batch would search again
    log = s.read.schema(found.schema).parquet(at)
    return phases.answers(asked_of, fx.region_models(s, d), folders.scratch(s, "answers"), "r1", fx.Canned, grounding=log, batches=4), log


@query("SELECT question_id, category, skipped, success, grounding, cost FROM f_searches")
def grounding_fetch(s, d):
    return phases.fetched(fx.talk_questions(s, d), fx.Canned, "search", 0.008).drop("seconds")


@query("SELECT question_id, model, text, in_tok, out_tok, cost, refused, error FROM f_given")
def answer_phase(s, d):
    return phase_answers(s, d)[0].select("question_id", "model", "text", "in_tok", "out_tok", "cost", "refused", "error")


@query(""", t AS (SELECT CASE WHEN grouping(model) = 1 THEN 'TOTAL' ELSE model END AS model, grouping(model) AS g, count(*) AS calls, sum(in_tok)::bigint AS in_tok, sum(out_tok)::bigint AS out_tok, round(sum(cost), 4) AS llm_cost, count(*) FILTER (refused) AS refused,
  count(error) AS errors FROM f_given GROUP BY ROLLUP (model)), s AS (SELECT round(coalesce(sum(cost), 0), 4) AS cost FROM f_searches)
SELECT model, calls, in_tok, out_tok, llm_cost, CASE WHEN g = 1 THEN s.cost ELSE 0 END AS search_cost, round(llm_cost + CASE WHEN g = 1 THEN s.cost ELSE 0 END, 4) AS total_cost, refused, errors FROM t CROSS JOIN s""")
def answer_totals(s, d):
    return phases.answer_totals(*phase_answers(s, d))


_MODE_SQL = "VALUES ('shuffle_only', true, false), ('blind_only', false, true), ('shuffle_blind', true, true)"


@query(f""", modes AS (SELECT * FROM ({_MODE_SQL}) t(mode, shuffle, blind)),
shown AS (SELECT mode, question_id, question, name AS model, CASE WHEN blind THEN concat('Response ', chr((64 + row_number() OVER w)::int)) ELSE name END AS label, row_number() OVER w AS place FROM modes CROSS JOIN f_talk CROSS JOIN f_regions
  WINDOW w AS (PARTITION BY mode, question_id ORDER BY CASE WHEN shuffle THEN md5(concat('42|', question_id, '|', name)) ELSE lpad(ordinal::varchar, 9, '0') END)),
judged AS (SELECT s.*, e.name AS evaluator, {fx._drawn_sql("e.name, '|', s.question, '|', s.label")} % 10 + 1 AS drawn, {fx._drawn_sql("e.name, '|', s.question, '|', f.label")} % 16 AS kind FROM shown s CROSS JOIN f_regions e JOIN shown f ON f.mode = s.mode AND f.question_id = s.question_id AND f.place = 1)
SELECT mode, evaluator, question_id, model, CASE WHEN kind <> 6 THEN drawn END::double AS score, NULL::varchar AS error FROM judged WHERE kind > 1
UNION ALL SELECT mode, evaluator, question_id, NULL, NULL, CASE kind WHEN 0 THEN 'content policy' ELSE 'no grades in the reply' END FROM judged WHERE kind <= 1 AND place = 1""")
def evaluation_phase(s, d):
    asked_of, roster_ = fx.talk_questions(s, d), fx.region_models(s, d)
    cells = phases.evaluations(asked_of, phase_answers(s, d)[0], roster_, folders.scratch(s, "cells"), "r1", fx.Canned)
    return cells.select("mode", "evaluator", "question_id", "model", "score", "error")


# names as judges write them, files of any form, reports
@query(", w AS (SELECT *, (q_ord + model_ord + evaluator_ord) % 6 AS kind FROM f_cells), n AS (SELECT evaluator_ord, q_ord, model_ord AS position, CASE kind WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE model_ord END AS m, json_extract(cell, '$.score') AS v FROM w WHERE json_type(cell) = 'OBJECT'), "
"s AS (SELECT evaluator_ord, q_ord, m, position, CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN v::double WHEN json_type(v) = 'BOOLEAN' THEN (v::boolean)::int::double WHEN json_type(v) = 'VARCHAR' AND regexp_full_match(trim(v->>'$'), '[0-9]+') THEN trim(v->>'$')::double END AS score FROM n WHERE m IS NOT NULL), "
"c AS (SELECT evaluator_ord, q_ord, m, arg_max(score, position) AS score FROM s WHERE score IS NOT NULL GROUP BY 1, 2, 3 HAVING evaluator_ord = 5 OR m <> evaluator_ord) "
"SELECT a.evaluator_ord, a.q_ord, a.m AS a, b.m AS b, CASE WHEN a.score > b.score THEN 1.0 WHEN a.score < b.score THEN 0.0 ELSE 0.5 END::double AS outcome FROM c a JOIN c b ON a.evaluator_ord = b.evaluator_ord AND a.q_ord = b.q_ord AND a.m < b.m")
def elo_raw_matches(s, d):
    known = roster(s, d).select(F.col("model").alias("name"), F.col("model_ord").alias("ordinal"))
    return elo.matches(elo.resolved(fx.raw_cells(s, d), known)).select("evaluator_ord", "q_ord", "a", "b", "outcome")


@query("""SELECT conv_id::varchar AS file, concat('m', conv_id % 5) AS source_model, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS j, CASE turn % 4 WHEN 0 THEN coalesce(min(role), 'none') ELSE 'general' END AS category, coalesce(min(text), '') AS question
FROM conversations GROUP BY conv_id, turn QUALIFY turn % 4 <> 3 AND NOT (turn % 4 = 2 AND coalesce(min(text), '') LIKE 'Error%')""", tables=False)
def mixed_questions(s, d):
    return json_files.mixed_questions(fx.question_files(s, d)).select("file", "source_model", "j", "category", "question")


@query("""WITH o AS (SELECT o_custkey::varchar AS file, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::int AS "row", concat('order ', o_orderkey) AS name, o_totalprice::decimal(15,2)::varchar AS p, substr(o_orderpriority, 1, 1) AS k FROM orders)
SELECT file, "row", name, 'Overall' AS "column", concat(k, ' (', p, ')') AS cell, p::double AS score FROM o UNION ALL SELECT file, "row", name, 'Recent', CASE k WHEN '5' THEN 'none' ELSE concat(k, ' (9.5)') END, CASE WHEN k <> '5' THEN 9.5 END FROM o""", tables=False)
def report_cells(s, d):
    return report.table_cells(report.table_rows(fx.report_files(s, d), ("Model", "Overall"), "("))


# the analysis of a validation as a document
_WILSON = lambda sign, p="(correct::double / total)", n="total::double": f"(({p} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n}) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n} * {n})) / (1 + {Z} * {Z} / {n}))"


@query(PT + f""", co AS ({CORR}), dm AS (SELECT cp.*, correct, total, abs(peer_rank - truth_rank) AS off, peer - truth AS diff FROM cp JOIN (SELECT model, correct, total FROM ac) a USING (model)),
al AS (SELECT count(*) AS n_models, max(total) AS questions, count(*) FILTER (off < 0.5) AS exact, count(*) FILTER (off <= 1.5) AS within_1, round(avg(off), 4) AS mean_diff, max(off) AS max_diff, arg_max(model, (diff, -model_ord)) AS over_rated, arg_min(model, (diff, model_ord)) AS under_rated,
  round(avg(accuracy), 4) AS mean_accuracy, round(stddev_pop(accuracy), 4) AS sd_accuracy FROM dm)
SELECT model, round(peer, 4) AS peer, truth, accuracy, peer_rank, truth_rank, round(diff, 4) AS diff, round(greatest(0, {_WILSON("-")}), 4) AS truth_low, round(least(1, {_WILSON("+")}), 4) AS truth_high, al.*, pearson, spearman,
  round(CASE WHEN n < 4 OR abs(pearson) >= 1 THEN pearson ELSE tanh(atanh(pearson) - {Z} / sqrt(n - 3)) END, 4) AS low, round(CASE WHEN n < 4 OR abs(pearson) >= 1 THEN pearson ELSE tanh(atanh(pearson) + {Z} / sqrt(n - 3)) END, 4) AS high
FROM dm CROSS JOIN al CROSS JOIN co""")
def validation_document(s, d):
    """The document is written, read back by a second call that need not make it, and shown a row a model."""
    folder = folders.scratch(s, "analysis")
    inputs = [f"{d}/lineitem.parquet", f"{d}/orders.parquet"]
    for _ in range(2):
        doc = analysis.kept(s, folder, inputs, lambda: analysis.document(_compared(s, d), "r1"), "Validation")
    c = analysis.comparison(doc)
    figures = [F.col(f"agreement.{x}").alias(x) for x in ("exact", "within_1", "mean_diff", "max_diff")] + [F.col(f"correlation.{x}").alias(x) for x in ("pearson", "spearman", "low", "high")]
    return c.select("model", "peer", "truth", "accuracy", "peer_rank", "truth_rank", "diff", "truth_low", "truth_high", "n_models", "questions", *figures, F.col("over_rated.model").alias("over_rated"), F.col("under_rated.model").alias("under_rated"), F.col("accuracies.mean").alias("mean_accuracy"), F.col("accuracies.sd").alias("sd_accuracy"))


@query(f""", cq AS (SELECT question_id, question, list(c ORDER BY md5(concat_ws('|', '42', question_id, c))) AS cs, any_value(first) AS first FROM (SELECT question_id, question, unnest(string_split(question, ' ')[1:4]) AS c, string_split(question, ' ')[1] AS first FROM f_talk) x GROUP BY 1, 2),
cp AS (SELECT question_id, chr((64 + list_position(cs, first))::int) AS letter, concat('Pick the right choice and reply with its letter only.', chr(10), chr(10), question, chr(10), chr(10), array_to_string(list_transform(cs, lambda c, i: concat(chr((64 + i)::int), '. ', c)), chr(10))) AS prompt FROM cq),
cr AS (SELECT question_id, name AS model, letter, {fx._drawn_sql("name, '|', prompt")} AS x FROM cp CROSS JOIN f_regions),
cm AS (SELECT *, CASE WHEN x % 16 IN (0, 1) THEN '?' ELSE 'ABCD'[x % 4 + 1] END AS meant FROM cr)
SELECT question_id, model, letter, meant, meant = letter AS correct, CASE WHEN x % 16 = 0 THEN 'invalid request' END AS error FROM cm""")
def choice_phase(s, d):
    asked_of = validation.choice_questions(fx.talk_choices(s, d))
    given = validation.choice_answers(asked_of, fx.region_models(s, d), folders.scratch(s, "choices"), "r1", fx.Canned, letters="cascade", batches=4)
    return given.select("question_id", "model", "letter", "meant", "correct", "error")


# rows of single operators
@query(STATS + ", tm AS (SELECT model, coalesce(avg(seconds) FILTER (seconds > 0), 0) AS seconds FROM f_timings GROUP BY 1) SELECT row_number() OVER (ORDER BY peer DESC, model_ord) AS rank, model, round(peer, 4) AS peer, round(sd, 4) AS sd, round(self, 4) AS self, round(self - peer, 4) AS self_minus_peer, round(raw, 4) AS raw, n, round(coalesce(seconds, 0), 4) AS seconds FROM st LEFT JOIN tm USING (model) WHERE n > 0")
def peer_rows(s, d):
    return scores.peer_rows(fx.scores(s, d), fx.timings(s, d))


@query(MODES + GRADED.lstrip() + ", bm AS (SELECT m.model, b.pm AS peer, CASE WHEN b.sn > 0 THEN b.sm END AS self, mean AS truth, a.pm AS named, p.pm AS placed FROM ac m JOIN ms b ON b.model = m.model AND b.mode = 'shuffle_blind' LEFT JOIN ms a ON a.model = m.model AND a.mode = 'shuffle_only' LEFT JOIN ms p ON p.model = m.model AND p.mode = 'blind_only' WHERE mean > 0) "
"SELECT model, round(peer, 4) AS peer, round(self, 4) AS self, truth, round(self - peer, 4) AS self_bias, round(named - peer, 4) AS name_bias, round(placed - peer, 4) AS position_bias FROM bm")
def ablation_by_model(s, d):
    return benchmark.ablation_by_model(fx.scores(s, d), _accuracy(s, d))


@query("""SELECT concat('m', conv_id % 5) AS source_model, CASE turn % 4 WHEN 0 THEN coalesce(min(role), 'none') ELSE 'general' END AS category, coalesce(min(text), '') AS question, substr(coalesce(min(text), ''), 1, 50) AS id
FROM conversations GROUP BY conv_id, turn HAVING turn % 4 <> 3 AND NOT (turn % 4 = 2 AND coalesce(min(text), '') LIKE 'Error%')""", tables=False)
def autopsy_rows(s, d):
    return questions.autopsy_rows(json_files.mixed_questions(fx.question_files(s, d)))
