"""Files of a run, named <base>_<revision>.json, read to flat tables and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import coercion
from ..operators.scores import BASE


def load(spark: SparkSession, folder: str, base: str, revision: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{base}_{revision}.json")


def load_optional(spark: SparkSession, folder: str, base: str, revision: str, schema: str) -> DataFrame:
    """As load(), but an empty table where the file is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{base}_{revision}.json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return load(spark, folder, base, revision, schema)


def latest_revision(spark: SparkSession, folder: str, base: str) -> str | None:
    files = spark.read.format("binaryFile").load(f"{folder}/{base}_*.json").select("path", "modificationTime")
    return files.agg(F.regexp_extract(F.max_by("path", "modificationTime"), f"{base}_(.+)\\.json$", 1)).first()[0]


def questions(df: DataFrame) -> DataFrame:
    """source_model, category (general if missing), question with order q_ord; error texts drop out, a repeated text keeps its last row."""
    s = df.select(F.posexplode(F.map_entries("questions_by_model")).alias("i", "m")).select("i", F.col("m.key").alias("source_model"), F.posexplode("m.value").alias("j", "q"))
    q = s.select("i", "j", "source_model", F.coalesce("q.category", F.lit("general")).alias("category"), F.col("q.question").alias("question"))
    q = q.where(~F.col("question").startswith("Error"))
    last = q.groupBy("question").agg(F.max_by(F.struct("source_model", "category"), F.struct("i", "j")).alias("x"), F.min(F.struct("i", "j")).alias("o"))
    return last.select("question", "x.source_model", "x.category", "o")


def whole(spark: SparkSession, path: str) -> DataFrame:
    """file and text of the files under a path, each a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def mixed_questions(files: DataFrame) -> DataFrame:
    """file, revision, i, source_model, j, category, question of question files (file, text) of any form.

    A model's entry is a list, or an object that wraps one as "questions"; of the list, objects with a question have
    their category or "general", texts are general questions unless they begin with Error, and anything else drops out.
    i and j are the places of model and question in the file; a file that is no JSON has no rows.
    """
    parsed = F.from_json("text", "revision string, questions_by_model map<string,string>")
    m = files.select("file", parsed.alias("p")).select("file", "p.revision", F.posexplode(F.map_entries("p.questions_by_model")).alias("i", "m"))
    value = F.try_parse_json("m.value")
    wrapped = F.schema_of_variant(value).startswith("OBJECT")
    entries = F.when(wrapped, F.try_variant_get(value, "$.questions", "array<variant>")).otherwise(F.try_variant_get(value, "$", "array<variant>"))
    q = m.select("file", "revision", "i", F.col("m.key").alias("source_model"), F.posexplode(entries).alias("j", "q"))
    kind = F.schema_of_variant("q")
    asked = F.try_variant_get("q", "$.question", "string")
    text = F.when(kind == "STRING", F.try_variant_get("q", "$", "string"))
    category = F.when(kind.startswith("OBJECT"), F.try_variant_get("q", "$.category", "string"))
    question = F.when(kind.startswith("OBJECT"), asked).when(~text.startswith("Error"), text)
    return q.select("file", "revision", "i", "source_model", "j", F.coalesce(category, F.lit("general")).alias("category"), question.alias("question")).where("question IS NOT NULL")


def answers(df: DataFrame) -> DataFrame:
    s = df.select(F.posexplode("questions").alias("q_ord", "q")).select("q_ord", "q.text", F.explode("q.answers").alias("model", "a"))
    return s.select("q_ord", F.col("text").alias("question"), "model", "a.*").withColumn("refused", F.coalesce("refused", F.trim("text") == ""))


def has_modes(files: DataFrame) -> bool:
    """Whether any of the evaluation files (file, text) tells its modes apart, by the merged schema of all."""
    merged = files.agg(F.schema_of_variant_agg(F.try_parse_json("text")).alias("s")).first()[0]
    return "evaluations_by_mode: OBJECT" in (merged or "")


def evaluation_files(files: DataFrame) -> DataFrame:
    """file, revision, timestamp, complete, evaluations_by_mode of evaluation files (file, text) of either form.

    A file without modes holds the evaluations of the blind, shuffled one; a file that has both is taken by its modes.
    A file that is no JSON, or has neither, drops out.
    """
    cells = "map<string,map<string,string>>"
    p = files.select("file", F.from_json("text", f"revision string, timestamp string, complete boolean, evaluations_by_mode map<string,{cells}>, evaluations {cells}").alias("p")).select("file", "p.*")
    one = F.when(F.col("evaluations").isNotNull(), F.create_map(F.lit(BASE), F.col("evaluations")))
    return p.withColumn("evaluations_by_mode", F.coalesce("evaluations_by_mode", one)).drop("evaluations").where("evaluations_by_mode IS NOT NULL")


def score_facts(df: DataFrame, policy: str = "lenient", modes: list[str] | None = None) -> DataFrame:
    """The score cube: revision, mode, evaluator, question, model with their orders, the raw cell and its score under a policy.

    A judge's reply for a question is a map of raw JSON texts, so one odd cell spoils no other; of a repeated key the last wins.
    """
    s = df.select("revision", F.explode("evaluations_by_mode").alias("mode", "e"))
    s = s.where(F.col("mode").isin(modes)) if modes else s
    s = s.select("revision", "mode", F.posexplode(F.map_entries("e")).alias("evaluator_ord", "e")).select("revision", "mode", "evaluator_ord", F.col("e.key").alias("evaluator"), F.posexplode(F.map_entries("e.value")).alias("q_ord", "q"))
    cells = F.map_entries(F.from_json(F.col("q.value"), "map<string,string>"))
    s = s.select("revision", "mode", "evaluator", "evaluator_ord", F.col("q.key").alias("question"), "q_ord", F.posexplode(cells).alias("model_ord", "c"))
    raw: Column = F.col("c.value")
    return s.select("revision", "mode", "evaluator", "evaluator_ord", "question", "q_ord", F.col("c.key").alias("model"), "model_ord", raw.alias("score_raw"), coercion.POLICIES[policy](raw).alias("score"))


def save(df: DataFrame, path: str) -> None:
    """The table as Parquet in folders by revision and mode, where it has them."""
    df.write.mode("overwrite").partitionBy(*[c for c in ("revision", "mode") if c in df.columns]).parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def truth_split(df: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """The public questions without the hidden fields, and the whole truth."""
    q = df.select(F.posexplode("questions").alias("q_ord", "q")).select("q_ord", "q.*")
    return q.drop(*hidden), q


def grounding(df: DataFrame) -> DataFrame:
    """index and text of the searches that found something."""
    g = df.select(F.explode("grounding").alias("g")).select("g.*")
    return g.where(F.col("index").isNotNull() & (F.col("grounding") != "")).select("index", "grounding")


def registry(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The models of a list of rows in its order: ordinal, provider, model_id, name, in_per_m, out_per_m, active."""
    flat = [(k, r["provider"], r["model_id"], r["name"], *map(float, r.get("cost", (0, 0))), bool(r.get("active", True))) for k, r in enumerate(rows)]
    return spark.createDataFrame(flat, "ordinal int, provider string, model_id string, name string, in_per_m double, out_per_m double, active boolean")


def active(models: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Models by name, ignoring case: those included, then without those excluded."""
    name = F.lower("name")
    m = models.where(name.isin([x.lower() for x in include])) if include else models
    return m.where(~name.isin([x.lower() for x in exclude])) if exclude else m


def active_categories(questions_: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Questions whose category holds any of the words, ignoring case."""
    has = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("category"), w))
    q = questions_.where(has(include)) if include else questions_
    return q.where(~has(exclude)) if exclude else q
