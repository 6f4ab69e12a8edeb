"""The phases that ask models: answers to questions, and grades of the answers under three ways of showing them.

A phase is done in batches. A batch is one Spark job that ends in one commit: the rows of its partition, keyed by
revision, are replaced together, so a batch is there whole or not at all and may be written again without harm. What
is committed is not asked again, so a phase that was broken off goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coercion, prompts
from ..functions.text import extracted_json
from ..operators.sampling import key
from ..sources.providers import Client, asked

ANSWERS = "question_id string, model string, text string, in_tok long, out_tok long, cost double, seconds double, error string, refused boolean, revision string, batch int"
CELLS = "evaluator string, question_id string, model string, score_raw string, score double, seconds double, error string, revision string, mode string"
QUESTIONS = "source_model string, ordinal int, j int, category string, question string, seconds double, revision string, attempt int"
#: Ways of showing answers to a judge: whether they are shuffled, whether names are hidden.
MODES = {"shuffle_only": (True, False), "blind_only": (False, True), "shuffle_blind": (True, True)}
#: A category with this word needs a search.
SEARCHED = "current"
#: Characters of a question that are searched for.
QUERY = 400
#: Results of a search that are kept, and characters of each.
RESULTS, EXCERPT = 5, 250


def committed(spark: SparkSession, path: str, schema: str, revision: str) -> DataFrame:
    """The rows of a revision; none where nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("revision") == revision)


def commit(rows: DataFrame, path: str, part: str) -> None:
    """Replace the partitions (revision, part) that the rows belong to, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("revision", part).parquet(path)


def providers_of(models: DataFrame) -> list[str]:
    """Models are a roster of some hundred rows at most."""
    return [r[0] for r in models.select("provider").distinct().where("provider IS NOT NULL").collect()]


def fetched(questions: DataFrame, connect: Callable[[str], Client], engine: str, cost: float, limits: dict[str, int] | None = None, results: int = RESULTS) -> DataFrame:
    """question_id, category, skipped, success, grounding, seconds, cost: a search for each question whose category needs one.

    engine: the search engine, whose client gives a line for its own answer and each result, best first; so many are
    kept, cut to EXCERPT characters. success is null where none was tried; a search that fails or finds nothing leaves
    no grounding and costs nothing.
    """
    need = F.contains(F.lower("category"), F.lit(SEARCHED))
    tried = questions.where(need).select("question_id", "category", F.lit(engine).alias("provider"), F.lit(engine).alias("model_id"), F.left("question", F.lit(QUERY)).alias("prompt"))
    found = asked(tried, [engine], connect, limits)
    good = F.col("error").isNull() & (F.trim("text") != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    said = F.array_join(F.transform(F.slice(lines, 1, results), lambda x: F.left(x, F.lit(EXCERPT))), " ")
    found = found.select("question_id", "category", F.lit(False).alias("skipped"), good.alias("success"), F.when(good, said).alias("grounding"), "seconds", F.when(good, F.lit(cost)).otherwise(F.lit(0.0)).alias("cost"))
    rest = questions.where(~F.coalesce(need, F.lit(False))).select("question_id", "category", F.lit(True).alias("skipped"), F.lit(None).cast("boolean").alias("success"), F.lit(None).cast("string").alias("grounding"), F.lit(0.0).alias("seconds"), F.lit(0.0).alias("cost"))
    return found.unionByName(rest)


def question_attempts(models: DataFrame, prompt: Column, path: str, revision: str, connect: Callable[[str], Client], most: int, attempts: int = 6, limits: dict[str, int] | None = None) -> Iterator[int]:
    """Every model makes up questions; yields the number of each attempt after its commit.

    A reply's list of objects, bare or wrapped as "questions", is taken, its first `most` objects with a question; a
    model without any is asked again in the next attempt, which makes up for failed calls too.
    """
    spark, providers = models.sparkSession, providers_of(models)
    for k in range(attempts):
        have = committed(spark, path, QUESTIONS, revision).select("source_model").distinct()
        missing = models.join(have, models["name"] == have["source_model"], "left_anti")
        if not missing.head(1):
            return
        replies = asked(missing.select(F.col("name").alias("source_model"), "ordinal", "provider", "model_id", prompt.alias("prompt")), providers, connect, limits)
        value = extracted_json(F.col("text"))
        entries = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.try_variant_get(value, "$.questions", "array<variant>")).otherwise(F.try_variant_get(value, "$", "array<variant>"))
        good = F.slice(F.filter(entries, lambda v: F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, "$.question", "string").isNotNull()), 1, most)
        rows = replies.select("source_model", "ordinal", "seconds", F.posexplode(good).alias("j", "q"))
        category = F.coalesce(F.try_variant_get("q", "$.category", "string"), F.lit("general"))
        out = rows.select("source_model", "ordinal", "j", category.alias("category"), F.try_variant_get("q", "$.question", "string").alias("question"), "seconds", F.lit(revision).alias("revision"), F.lit(k).alias("attempt"))
        commit(out, path, "attempt")
        yield k


def made_questions(models: DataFrame, prompt: Column, path: str, revision: str, connect: Callable[[str], Client], most: int, **how) -> DataFrame:
    """The questions of a revision, after asking the models that have none yet; a model that failed every time has no row."""
    for _ in question_attempts(models, prompt, path, revision, connect, most, **how):
        pass
    return committed(models.sparkSession, path, QUESTIONS, revision)


def answer_batches(questions: DataFrame, models: DataFrame, path: str, revision: str, connect: Callable[[str], Client], grounding: DataFrame | None = None, batches: int = 8, limits: dict[str, int] | None = None, again: bool = False) -> Iterator[int]:
    """Every model answers every question; yields the number of each batch after its commit.

    questions: question_id, one row each and none null, and question, or a prompt of their own in its place; models: name, provider, model_id, in_per_m, out_per_m; grounding: question_id,
    grounding. Batches are dealt by question. What is committed is not asked again; with again, what ended in an error
    is. An answer without text is a refusal, a failed call an answer that says so, without tokens or cost.
    """
    spark, providers = questions.sparkSession, providers_of(models)
    text = questions.join(grounding.select("question_id", "grounding"), "question_id", "left") if grounding is not None else questions.withColumn("grounding", F.lit(None).cast("string"))
    prompt = prompts.grounded(F.col("prompt"), F.col("grounding")) if "prompt" in questions.columns else prompts.answer_prompt(F.col("question"), F.col("grounding"))
    tasks = text.select("question_id", prompt.alias("prompt"), F.pmod(F.xxhash64("question_id"), F.lit(batches)).cast("int").alias("batch"))
    tasks = tasks.crossJoin(models.select(F.col("name").alias("model"), "provider", "model_id", "in_per_m", "out_per_m"))
    for k in range(batches):
        done = committed(spark, path, ANSWERS, revision).where(F.col("batch") == k)
        kept = done.where("error IS NULL") if again else done
        missing = tasks.where(F.col("batch") == k).join(kept.select("question_id", "model"), ["question_id", "model"], "left_anti")
        if not missing.head(1):
            continue
        new = asked(missing, providers, connect, limits)
        cost = F.round((F.col("in_tok") * F.coalesce("in_per_m", F.lit(0.0)) + F.col("out_tok") * F.coalesce("out_per_m", F.lit(0.0))) / 1e6, 6)
        said = F.coalesce("text", F.concat(F.lit("Error: "), "error"))
        refused = F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) == "")
        rows = new.select("question_id", "model", said.alias("text"), "in_tok", "out_tok", cost.alias("cost"), "seconds", "error", refused.alias("refused"), F.lit(revision).alias("revision"), "batch")
        commit(rows.unionByName(kept), path, "batch")
        yield k


def answers(questions: DataFrame, models: DataFrame, path: str, revision: str, connect: Callable[[str], Client], **how) -> DataFrame:
    """The answers of a revision, after asking for all that were not committed yet."""
    for _ in answer_batches(questions, models, path, revision, connect, **how):
        pass
    return committed(questions.sparkSession, path, ANSWERS, revision)


def answer_totals(given: DataFrame, grounding: DataFrame | None = None) -> DataFrame:
    """Calls, tokens, cost, refusals and errors of each model, and of all as TOTAL, which bears the cost of searches too."""
    sums = [F.count("*").alias("calls"), F.sum("in_tok").alias("in_tok"), F.sum("out_tok").alias("out_tok"), F.round(F.sum("cost"), 4).alias("llm_cost"), F.count_if("refused").alias("refused"), F.count_if(F.col("error").isNotNull()).alias("errors")]
    t = given.rollup("model").agg(*sums, F.grouping("model").alias("g"))
    searches = grounding.agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("s")) if grounding is not None else given.sparkSession.range(1).select(F.lit(0.0).alias("s"))
    t = t.crossJoin(searches)  # one row
    extra = F.when(F.col("g") == 1, F.col("s")).otherwise(F.lit(0.0))
    return t.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("model")).alias("model"), "calls", "in_tok", "out_tok", "llm_cost", extra.alias("search_cost"), F.round(F.col("llm_cost") + extra, 4).alias("total_cost"), "refused", "errors")


def shown(questions: DataFrame, given: DataFrame, models: DataFrame, shuffle: bool, blind: bool, most: int | None = None, answered: bool = False) -> DataFrame:
    """question_id, question, labelled: the answers of all models (N/A where there is none) in the order and under the labels of a mode, cut to so many characters; answered: only of models that have one."""
    given = given.withColumn("text", F.left("text", F.lit(most))) if most else given
    grid = questions.select("question_id", "question").crossJoin(models.select(F.col("name").alias("model"), "ordinal"))
    text = grid.join(given.select("question_id", "model", "text"), ["question_id", "model"], "inner" if answered else "left")
    order = key(F.col("question_id"), F.col("model")) if shuffle else F.lpad(F.col("ordinal").cast("string"), 9, "0")
    rows = text.groupBy("question_id", "question").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), "model", F.coalesce("text", F.lit("N/A")).alias("text")))).alias("r"))
    letters = lambda i: F.when(i < 26, F.char(F.lit(65) + i)).otherwise(F.concat(F.char(F.lit(64) + F.floor(i / 26)), F.char(F.lit(65) + i % 26)))
    label = lambda x, i: F.concat(F.lit("Response "), letters(i)) if blind else x["model"]
    return rows.select("question_id", "question", F.transform("r", lambda x, i: F.struct(label(x, i).alias("label"), x["text"].alias("text"), x["model"].alias("model"))).alias("labelled"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often it is used, also for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read_cells(reply: Column, labelled: Column, exact: bool = False) -> Column:
    """An array of (model, cell) from a reply: its JSON object's entries, labels put back to models.

    A label is looked up as it stands, else, unless exact, the first that holds it or is held by it is taken. Of entries for one model
    an exact label wins, then the greatest; a reply without an object gives null.
    """
    def model_of(label: Column) -> Column:
        same = F.filter(labelled, lambda x: x["label"] == label)
        near = F.filter(labelled, lambda x: F.contains(x["label"], label) | F.contains(label, x["label"]))
        return F.get(same, F.lit(0)) if exact else F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0)))

    def entries(value: Column) -> Column:
        return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.map_entries(F.from_json(F.to_json(value), "map<string,string>")))

    def placed(e: Column) -> Column:
        return once(model_of(e["key"]), lambda m: F.struct(m["model"].alias("model"), (m["label"] == e["key"]).alias("exact"), e["key"].alias("label"), e["value"].alias("cell")))

    def best(found: Column) -> Column:
        better = lambda c, d: (c["model"] == d["model"]) & (F.struct(d["exact"], d["label"]) > F.struct(c["exact"], c["label"]))
        return F.filter(found, lambda c: ~F.exists(found, lambda d: better(c, d)))

    found = F.filter(F.transform(once(extracted_json(reply), entries), placed), lambda c: c["model"].isNotNull())
    return F.transform(once(found, best), lambda c: F.struct(c["model"].alias("model"), c["cell"].alias("cell")))


def evaluation_modes(questions: DataFrame, given: DataFrame, models: DataFrame, path: str, revision: str, connect: Callable[[str], Client], grounding: DataFrame | None = None, limits: dict[str, int] | None = None, policy: str = "lenient", prompt: Callable[[DataFrame], Column] | None = None, most: int | None = None, exact: bool = False, modes: list[str] | None = None, answered: bool = False) -> Iterator[str]:
    """Every model grades the answers to every question in each mode; yields the name of each mode after its commit.

    A cell is a row; a call that failed, or a reply without grades, is a row with an error and no model. Modes that are
    committed are left out. grounding: question_id, grounding, put before the prompt. prompt: made from the questions'
    rows (with labelled) in place of the usual one; most: characters of an answer that are shown; exact: as read_cells(); modes: only these; answered: only models with an
    answer are shown, and judge.
    """
    spark, providers = questions.sparkSession, providers_of(models)
    for mode, (shuffle, blind) in MODES.items():
        if (modes and mode not in modes) or committed(spark, path, CELLS, revision).where(F.col("mode") == mode).head(1):
            continue
        rows = shown(questions, given, models, shuffle, blind, most, answered).drop("question").join(questions, "question_id")
        text = prompt(rows) if prompt else prompts.grading_prompt(F.col("question"), F.col("labelled"))
        if grounding is not None:
            rows = rows.join(grounding.select("question_id", "grounding"), "question_id", "left")
            text = prompts.grounded(text, F.col("grounding"))
        tasks = rows.select("question_id", "labelled", text.alias("prompt")).crossJoin(models.select(F.col("name").alias("evaluator"), "provider", "model_id"))
        if answered:
            tasks = tasks.where(F.exists("labelled", lambda x: x["model"] == F.col("evaluator")))
        replies = asked(tasks, providers, connect, limits)
        cells = replies.withColumn("cells", read_cells(F.col("text"), F.col("labelled"), exact))
        none = F.when(F.col("cells").isNull() | (F.size("cells") == 0), F.coalesce("error", F.lit("no grades in the reply")))
        flat = cells.select("evaluator", "question_id", none.alias("error"), "seconds", F.explode_outer("cells").alias("c"))
        out = flat.select("evaluator", "question_id", "c.model", F.col("c.cell").alias("score_raw"), coercion.POLICIES[policy](F.col("c.cell")).alias("score"), "seconds", "error", F.lit(revision).alias("revision"), F.lit(mode).alias("mode"))
        commit(out, path, "mode")
        yield mode


def evaluations(questions: DataFrame, given: DataFrame, models: DataFrame, path: str, revision: str, connect: Callable[[str], Client], **how) -> DataFrame:
    """The cells of a revision in all modes, after asking for those not committed yet."""
    for _ in evaluation_modes(questions, given, models, path, revision, connect, **how):
        pass
    return committed(questions.sparkSession, path, CELLS, revision)


def session(question: DataFrame, models: DataFrame, folder: str, revision: str, connect: Callable[[str], Client], modes: list[str] | None = None, limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers and cells of a session, whose questions (question_id, question) are one or a few.

    A model that failed or left its answer blank is not shown to judges, nor asked to be one. Without modes all are run.
    """
    given = answers(question, models, f"{folder}/answers", revision, connect, batches=1, limits=limits)
    good = given.where("error IS NULL AND NOT refused")
    spark, path = question.sparkSession, f"{folder}/cells"
    for _ in evaluation_modes(question, good, models, path, revision, connect, limits=limits, modes=modes, answered=True):
        pass
    return given, committed(spark, path, CELLS, revision)
