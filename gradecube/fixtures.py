"""The engine's tables made from star-schema test data, so that every query runs on it."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_MODELS, N_QUESTIONS = 12, 100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(prefix: str, n) -> F.Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    out = n.where(key < N_MODELS).join(r, n.n_regionkey == r.r_regionkey)
    return out.select(key.cast("int").alias("ordinal"), F.col("n_name").alias("name"), F.col("r_name").alias("provider"), (0.25 + key * 0.25).cast("double").alias("in_per_m"), (1 + key).cast("double").alias("out_per_m"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question stands for all orders with one remainder; it has the category and the source of the first of them."""
    o = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % N_QUESTIONS).cast("int").alias("q_ord")).agg(F.min_by(F.struct("o_orderpriority", "o_custkey"), "o_orderkey").alias("o"))
    return o.select("q_ord", named("Q", F.col("q_ord")).alias("question"), F.col("o.o_orderpriority").alias("category"), named("NATION_", F.col("o.o_custkey") % N_MODELS).alias("source_model"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mode, evaluator, evaluator_ord, question, q_ord, model, model_ord, score: one row a cell."""
    li = read(spark, sf_dir, "lineitem")
    mode = F.when(F.col("l_returnflag") == "A", "shuffle_only").when(F.col("l_returnflag") == "N", "blind_only").otherwise("shuffle_blind")
    e, q, m = (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % N_MODELS, F.col("l_orderkey") % N_QUESTIONS, F.col("l_partkey") % N_MODELS
    cells = li.select(mode.alias("mode"), e.cast("int").alias("evaluator_ord"), q.cast("int").alias("q_ord"), m.cast("int").alias("model_ord"), F.col("l_quantity").cast("int").alias("x"))
    cells = cells.groupBy("mode", "evaluator_ord", "q_ord", "model_ord").agg((1 + F.sum("x") % 10).cast("double").alias("score"))
    return cells.select("mode", named("NATION_", F.col("evaluator_ord")).alias("evaluator"), "evaluator_ord", named("Q", F.col("q_ord")).alias("question"), "q_ord", named("NATION_", F.col("model_ord")).alias("model"), "model_ord", "score")


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(named("NATION_", F.col("user_id") % N_MODELS).alias("model"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("seconds"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("q_ord", "question", ((F.col("q_ord") * 37) % 50).cast("double").alias("gold_num"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q_ord, model, model_ord, in_tok, out_tok, num and a text of one of six shapes."""
    li = read(spark, sf_dir, "lineitem")
    q, m = (F.col("l_orderkey") % N_QUESTIONS).cast("int"), (F.col("l_partkey") % N_MODELS).cast("int")
    a = li.groupBy(q.alias("q_ord"), m.alias("model_ord")).agg(F.sum(F.col("l_quantity").cast("int")).alias("s"), F.sum(F.col("l_quantity").cast("int") * 10).alias("in_tok"), F.sum(F.floor("l_extendedprice")).alias("out_tok"))
    num = F.when(F.col("s") % 3 == 0, (F.col("q_ord") * 37) % 50).otherwise(F.col("s") % 50)
    a = a.select("q_ord", named("NATION_", F.col("model_ord")).alias("model"), "model_ord", "in_tok", "out_tok", num.alias("num"))
    n, shape = F.col("num").cast("string"), (F.col("q_ord") + F.col("model_ord")) % 6
    text = (
        F.when(shape == 0, F.concat(F.lit("Work: 2+2=4. #### 1,"), (100 + F.col("num")).cast("string")))
        .when(shape == 1, F.concat(F.lit("The final answer is $"), n, F.lit(" dollars")))
        .when(shape == 2, F.concat(F.lit("Therefore we get "), n, F.lit(" apples")))
        .when(shape == 3, F.concat(F.lit("Result \\boxed{"), n, F.lit("}")))
        .when(shape == 4, F.concat(F.lit("I computed 12 then "), n))
        .otherwise("")
    )
    return a.withColumn("text", text)


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of searches: every question asked, of which some categories need none."""
    q = questions(spark, sf_dir)
    skipped = F.col("q_ord") % 5 == 0
    return q.select("q_ord", "category", skipped.alias("skipped"), F.when(~skipped, F.col("q_ord") % 7 != 0).alias("success"), F.when(~skipped, (F.col("q_ord") % 9) / 2.0).otherwise(0.0).alias("duration"))


#: Score cells of every kind.
CELLS = ['{"score": 7}', '{"score": 7.5}', '{"score": "7"}', '{"score": "7.5"}', '{"score": " 8 "}', '{"score": "-3"}', '{"score": "1e1"}', '{"score": "7..5"}', '{"score": "8/10"}', '{"score": "7d"}', '{"score": true}', '{"score": null}', '{"reason": "x"}', "null", "7", '"7"', '{"score": 9, "reason": "good"}']


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the blind, shuffled mode with a raw JSON score of some kind."""
    kind = (F.col("q_ord") * 5 + F.col("model_ord") * 3 + F.col("evaluator_ord")) % len(CELLS)
    return scores(spark, sf_dir).where("mode = 'shuffle_blind'").select("evaluator_ord", "q_ord", "model_ord", F.get(F.array(*map(F.lit, CELLS)), kind).alias("cell"))


def talk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, category: each user turn of the conversations, once; a third are of current events."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("question"))
    category = F.when(F.col("conv_id") % 3 == 0, "Current events").otherwise("general")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), "question", category.alias("category"))


def talk_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, choices: each user turn of the conversations, its first four words being the choices and the first the right one."""
    return talk_questions(spark, sf_dir).select("question_id", "question", F.slice(F.split("question", " "), 1, 4).alias("choices"))


def region_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roster of five models, each of a provider of its own."""
    key = F.col("r_regionkey")
    return read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lower("r_name").alias("provider"), F.col("r_name").alias("model_id"), key.cast("int").alias("ordinal"), (0.25 + key * 0.25).cast("double").alias("in_per_m"), (1 + key).cast("double").alias("out_per_m"))


#: Sentences that the rules look for, put after the texts of questions.
PHRASES = ["A block on a plane at an angle of incline 30 degrees with friction", "A car must accelerate to reach a velocity", "Sound exits one medium and enters a denser one", "A fire hose has a nozzle with water velocity", "The patient has high blood pressure", "The pendulum has a period of two seconds", "Freud described attachment", "An ideal gas law question at constant volume", "Which folkways does a society hold", "The coefficient of kinetic friction is 0.2", "Who held the world record in 1886", "A lens of focal length 10", "Hormones act on cells"]
PLAIN_ANSWERS = ["10 m/s", "20 m/s", "5 m/s", "1 m/s"]
SUBJECTS = ["anatomy", "college_medicine", "virology", "econometrics", "college_medicine", "philosophy", "professional_law", "machine_learning"]


def subject_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q_ord, question, choices, subject: each user turn of the conversations, most with a sentence that some rule looks for, and each item of the benchmark."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("t"))
    c = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_ord"), "t")
    b = read(spark, sf_dir, "benchmark").groupBy("item_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("t")).select((-1 - F.col("item_id")).alias("q_ord"), "t")
    o = F.pmod("q_ord", F.lit(16 * 8 + 5))
    phrase = F.coalesce(F.get(F.array(*map(F.lit, PHRASES)), (o % 16).cast("int")), F.lit(""))
    choices = F.when(o % 2 == 0, F.array(*map(F.lit, PLAIN_ANSWERS))).otherwise(F.slice(F.split("t", " "), 1, 4))
    return c.unionByName(b).select("q_ord", F.concat("t", F.lit(" "), phrase).alias("question"), choices.alias("choices"), F.get(F.array(*map(F.lit, SUBJECTS)), (o % 8).cast("int")).alias("subject"))


#: The same as DuckDB common table expressions.
SUBJECT_SQL = f""", f_texts AS (SELECT conv_id * 1000 + turn AS q_ord, coalesce(min(text), '') AS t FROM conversations WHERE role = 'user' GROUP BY conv_id, turn UNION ALL SELECT -1 - item_id, coalesce(min(text), '') FROM benchmark GROUP BY item_id),
f_subject AS (SELECT q_ord, concat(t, ' ', ({PHRASES!r})[o % 16 + 1]) AS question, CASE WHEN o % 2 = 0 THEN {PLAIN_ANSWERS!r} ELSE string_split(t, ' ')[1:4] END AS choices, ({SUBJECTS!r})[o % 8 + 1] AS subject FROM (SELECT *, ((q_ord % 133) + 133) % 133 AS o FROM f_texts) x)
"""


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cells with models' names as judges write them: bracketed, in lower case, cut short or unknown."""
    c = cells(spark, sf_dir)
    k, kind = F.col("model_ord").cast("string"), (F.col("q_ord") + F.col("model_ord") + F.col("evaluator_ord")) % 6
    written = F.when(kind == 1, F.concat(F.lit("["), named("NATION_", k), F.lit("]"))).when(kind == 2, F.concat(F.lit(" nation_"), k, F.lit(" "))).when(kind == 3, F.lit("nation")).when(kind == 4, F.concat(F.lit("other "), k)).otherwise(named("NATION_", k))
    judge = F.when(F.col("evaluator_ord") == 5, F.lit("a guest")).otherwise(F.concat(F.lit("nation_"), F.col("evaluator_ord").cast("string")))
    return c.select(F.lit("shuffle_blind").alias("mode"), judge.alias("evaluator"), "evaluator_ord", "q_ord", written.alias("model"), F.col("model_ord").alias("position"), "cell")


def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question file for each conversation, whose turns are entries of every form."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("t"), F.coalesce(F.min("role"), F.lit("none")).alias("role"))
    quoted = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    entry = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.col("role").alias("category"), F.col("t").alias("question"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.col("t").alias("question"))))
        .when(F.col("turn") % 4 == 2, quoted(F.col("t")))
        .otherwise(quoted(F.concat(F.lit("Error: "), F.col("t"))))
    )
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))).alias("es"))
    body = F.concat(F.lit("["), F.array_join(F.col("es.e"), ","), F.lit("]"))
    body = F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit('{"questions":'), body, F.lit("}"))).otherwise(body)
    text = F.concat(F.lit('{"revision":"r1","questions_by_model":{"m'), (F.col("conv_id") % 5).cast("string"), F.lit('":'), body, F.lit("}}"))
    return lists.select(F.col("conv_id").cast("string").alias("file"), text.alias("text"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each customer, whose second table has a row for each of the customer's orders."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("p"), F.substring("o_orderpriority", 1, 1).alias("k"))
    line = F.concat(F.lit("| order "), F.col("o_orderkey").cast("string"), F.lit(" | "), "k", F.lit(" ("), "p", F.lit(") | "), F.when(F.col("k") == "5", "none").otherwise(F.concat("k", F.lit(" (9.5)"))), F.lit(" |"))
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("ls"))
    head = "# Report\n\n| Model | Other |\n|---|---|\n| none | 1 (1.0) |\n\n## Rankings\n\n| Model    | Overall | Recent |\n|----------|--------:|--------|\n"
    tail = "\n\nSome words | with bars.\n| Model | Overall | Late |\n| late | 1 (2.0) | 2 (3.0) |\n"
    return lists.select(F.col("o_custkey").cast("string").alias("file"), F.concat(F.lit(head), F.array_join(F.col("ls.l"), "\n"), F.lit(tail)).alias("text"))


def drawn(*parts: str) -> int:
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16)


class Canned:
    """A client whose replies depend on model and prompt alone: some calls fail, some answers are blank, some grades odd."""

    def __init__(self, provider: str):
        self.provider = provider

    def ask(self, model_id: str, prompt: str) -> tuple[str, int, int]:
        text = self.found(prompt) if self.provider == "search" else self.grades(model_id, prompt) if "Reply with JSON" in prompt else self.answer(model_id, prompt)
        return text, len(prompt) // 4, len(text) // 4

    def found(self, prompt: str) -> str:
        x = drawn("search", prompt)
        return f"Found {x % 1000}." if x % 5 else ""

    def answer(self, model_id: str, prompt: str) -> str:
        x = drawn(model_id, prompt)
        if x % 16 == 0:
            raise ValueError("invalid request")
        if prompt.startswith("Pick the right choice"):
            letter = "ABCD"[x % 4]
            return [letter, f"({letter})", f"The answer is {letter}.", f"ABCD? I choose {letter}"][x // 4 % 4] if x % 16 != 1 else " "
        return " " if x % 16 == 1 else f"The answer is {x % 100}."

    def grades(self, model_id: str, prompt: str) -> str:
        question, rest = prompt.split("Question: ", 1)[1].split("\n\n--- ", 1)
        labels = re.findall(r"^--- (.+) ---$", "--- " + rest, re.M)
        kind = drawn(model_id, question, labels[0]) % 16
        if kind == 0:
            raise ValueError("content policy")
        if kind == 1:
            return "I cannot grade these."
        out = {}
        for label in labels:
            score = drawn(model_id, question, label) % 10 + 1
            cell = {"reason": "as seen"} if kind == 6 else {"reason": "as seen", "score": str(score) if kind == 5 else score}
            out[label.removeprefix("Response ") if kind == 4 else label] = cell
        text = json.dumps(out)
        return f"```json\n{text}\n```" if kind == 2 else f"My grades are {text} as asked." if kind == 3 else text


_CELL_SQL = ", ".join("'" + c.replace("'", "''") + "'" for c in CELLS)
_drawn_sql = lambda parts: f"('0x' || substr(md5(concat({parts})), 1, 8))::bigint"
#: The same tables as DuckDB common table expressions.
SQL = f"""WITH f_models AS (SELECT cast(n_nationkey AS int) AS ordinal, n_name AS name, r_name AS provider, cast(0.25 + n_nationkey * 0.25 AS double) AS in_per_m, cast(1 + n_nationkey AS double) AS out_per_m
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < {N_MODELS}),
f_questions AS (SELECT cast(o_orderkey % {N_QUESTIONS} AS int) AS q_ord, concat('Q', (o_orderkey % {N_QUESTIONS})::varchar) AS question, arg_min(o_orderpriority, o_orderkey) AS category, concat('NATION_', (arg_min(o_custkey, o_orderkey) % {N_MODELS})::varchar) AS source_model FROM orders GROUP BY o_orderkey % {N_QUESTIONS}),
f_scores AS (SELECT CASE l_returnflag WHEN 'A' THEN 'shuffle_only' WHEN 'N' THEN 'blind_only' ELSE 'shuffle_blind' END AS mode,
  concat('NATION_', ((l_suppkey * 7 + l_linenumber) % {N_MODELS})::varchar) AS evaluator, cast((l_suppkey * 7 + l_linenumber) % {N_MODELS} AS int) AS evaluator_ord,
  concat('Q', (l_orderkey % {N_QUESTIONS})::varchar) AS question, cast(l_orderkey % {N_QUESTIONS} AS int) AS q_ord, concat('NATION_', (l_partkey % {N_MODELS})::varchar) AS model, cast(l_partkey % {N_MODELS} AS int) AS model_ord,
  cast(1 + sum(cast(l_quantity AS int)) % 10 AS double) AS score FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6, 7),
f_timings AS (SELECT concat('NATION_', (user_id % {N_MODELS})::varchar) AS model, CASE WHEN event_type = 'error' THEN 0::double ELSE value END AS seconds FROM events),
f_gold AS (SELECT q_ord, question, cast((q_ord * 37) % 50 AS double) AS gold_num FROM f_questions),
f_answers AS (SELECT q_ord, model, model_ord, in_tok, out_tok, num, CASE (q_ord + model_ord) % 6 WHEN 0 THEN concat('Work: 2+2=4. #### 1,', (100 + num)::varchar) WHEN 1 THEN concat('The final answer is $', num::varchar, ' dollars')
    WHEN 2 THEN concat('Therefore we get ', num::varchar, ' apples') WHEN 3 THEN concat('Result ', chr(92), 'boxed{{', num::varchar, '}}') WHEN 4 THEN concat('I computed 12 then ', num::varchar) ELSE '' END AS text
  FROM (SELECT q_ord, model, model_ord, in_tok, out_tok, CASE WHEN s % 3 = 0 THEN (q_ord * 37) % 50 ELSE s % 50 END::bigint AS num
    FROM (SELECT cast(l_orderkey % {N_QUESTIONS} AS int) AS q_ord, concat('NATION_', (l_partkey % {N_MODELS})::varchar) AS model, cast(l_partkey % {N_MODELS} AS int) AS model_ord,
      sum(cast(l_quantity AS int))::bigint AS s, sum(cast(l_quantity AS int) * 10)::bigint AS in_tok, sum(cast(floor(l_extendedprice) AS bigint))::bigint AS out_tok FROM lineitem GROUP BY 1, 2, 3) a) b),
f_grounding AS (SELECT q_ord, category, q_ord % 5 = 0 AS skipped, CASE WHEN q_ord % 5 <> 0 THEN q_ord % 7 <> 0 END AS success, CASE WHEN q_ord % 5 <> 0 THEN (q_ord % 9) / 2.0 ELSE 0 END::double AS duration FROM f_questions),
f_cells AS (SELECT evaluator_ord, q_ord, model_ord, ([{_CELL_SQL}])[(q_ord * 5 + model_ord * 3 + evaluator_ord) % {len(CELLS)} + 1] AS cell FROM f_scores WHERE mode = 'shuffle_blind'),
f_talk AS (SELECT concat(conv_id, ':', turn) AS question_id, coalesce(min(text), '') AS question, CASE WHEN conv_id % 3 = 0 THEN 'Current events' ELSE 'general' END AS category FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
f_regions AS (SELECT r_name AS name, r_regionkey AS ordinal, 0.25 + r_regionkey * 0.25 AS in_per_m, 1 + r_regionkey AS out_per_m FROM region),
f_searches AS (SELECT question_id, category, x IS NULL AS skipped, x % 5 <> 0 AS success, CASE WHEN x % 5 <> 0 THEN concat('Found ', x % 1000, '.') END AS grounding, CASE WHEN x % 5 <> 0 THEN 0.008 ELSE 0 END::double AS cost
  FROM (SELECT *, CASE WHEN category = 'Current events' THEN {_drawn_sql("'search', '|', substr(question, 1, 400)")} END AS x FROM f_talk) s),
f_replies AS (SELECT question_id, name, x, CASE x % 16 WHEN 0 THEN 'Error: invalid request' WHEN 1 THEN ' ' ELSE concat('The answer is ', x % 100, '.') END AS text, CASE WHEN x % 16 = 0 THEN 0 ELSE length(prompt) // 4 END AS in_tok,
    in_per_m, out_per_m FROM (SELECT *, {_drawn_sql("name, '|', prompt")} AS x FROM (SELECT q.question_id, m.*, concat(CASE WHEN grounding IS NOT NULL THEN concat('Recent sources:', chr(10), grounding, chr(10), chr(10)) END,
      'Answer this question clearly and briefly.', chr(10), chr(10), question) AS prompt FROM f_talk q JOIN f_searches USING (question_id) CROSS JOIN f_regions m) p) r),
f_given AS (SELECT question_id, name AS model, text, in_tok, out_tok, round((in_tok * in_per_m + out_tok * out_per_m) / 1e6, 6) AS cost, x % 16 = 1 AS refused, CASE WHEN x % 16 = 0 THEN 'invalid request' END AS error
  FROM (SELECT *, CASE WHEN x % 16 = 0 THEN 0 ELSE length(text) // 4 END AS out_tok FROM f_replies) g),
peer AS (SELECT * FROM f_scores WHERE mode = 'shuffle_blind' AND evaluator <> model)
"""
