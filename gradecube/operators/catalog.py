"""Small dimensions of benchmarks, and the rows of work that runs make from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories of one benchmark in the engine's terms; others are factual knowledge.
CATEGORY_MAP = {
    "Logical Falsehood": "reasoning/logic",
    "Statistics": "reasoning/logic",
    "Indexical Error: Identity": "reasoning/logic",
    "Indexical Error: Location": "reasoning/logic",
    "Indexical Error: Time": "reasoning/logic",
    "Indexical Error: Other": "reasoning/logic",
    "Confusion: People": "reasoning/logic",
    "Confusion: Places": "reasoning/logic",
    "Confusion: Other": "reasoning/logic",
    "Subjective": "creative/open-ended",
    "Proverbs": "creative/open-ended",
    "Nutrition": "practical how-to",
    "Health": "practical how-to",
    "Politics": "current events (needs recent info)",
    "Misinformation": "current events (needs recent info)",
}
DEFAULT_CATEGORY = "factual knowledge"
#: Groups of subjects, by domain first, then broad ones.
SUBJECT_GROUPS = {
    "medical": [
        "clinical_knowledge", "medical_genetics", "anatomy", "professional_medicine", "college_biology", "virology",
        "nutrition", "human_aging",
    ],
    "law": [
        "professional_law", "international_law", "jurisprudence", "moral_disputes", "moral_scenarios",
    ],
    "computer_science": [
        "college_computer_science", "high_school_computer_science", "computer_security", "machine_learning",
    ],
    "math": [
        "abstract_algebra", "college_mathematics", "high_school_mathematics", "elementary_mathematics",
        "high_school_statistics", "econometrics",
    ],
    "physics": [
        "college_physics", "high_school_physics", "conceptual_physics", "astronomy",
    ],
    "chemistry": [
        "college_chemistry", "high_school_chemistry",
    ],
    "biology": [
        "college_biology", "high_school_biology", "anatomy", "virology", "medical_genetics",
    ],
    "history": [
        "high_school_european_history", "high_school_us_history", "high_school_world_history", "prehistory",
    ],
    "psychology": [
        "high_school_psychology", "professional_psychology", "human_sexuality", "human_aging",
    ],
    "economics": [
        "econometrics", "high_school_macroeconomics", "high_school_microeconomics", "management", "marketing",
        "business_ethics",
    ],
    "philosophy": [
        "philosophy", "formal_logic", "logical_fallacies", "moral_disputes", "moral_scenarios", "world_religions",
    ],
    "STEM": [
        "abstract_algebra", "anatomy", "astronomy", "college_biology", "college_chemistry",
        "college_computer_science", "college_mathematics", "college_physics", "computer_security",
        "conceptual_physics", "electrical_engineering", "elementary_mathematics", "machine_learning",
        "high_school_biology", "high_school_chemistry", "high_school_computer_science", "high_school_mathematics",
        "high_school_physics", "high_school_statistics", "virology",
    ],
    "Humanities": [
        "high_school_european_history", "high_school_us_history", "high_school_world_history", "philosophy",
        "prehistory", "world_religions", "logical_fallacies", "formal_logic",
    ],
    "Social Sciences": [
        "econometrics", "high_school_geography", "high_school_government_and_politics", "high_school_macroeconomics",
        "high_school_microeconomics", "high_school_psychology", "human_sexuality", "public_relations",
        "security_studies", "sociology", "us_foreign_policy",
    ],
    "Professional": [
        "business_ethics", "clinical_knowledge", "college_medicine", "management", "marketing", "medical_genetics",
        "professional_accounting", "professional_law", "professional_medicine", "professional_psychology",
        "international_law", "jurisprudence",
    ],
    "Other": [
        "global_facts", "human_aging", "miscellaneous", "moral_disputes", "moral_scenarios", "nutrition",
    ],
}


def subject_groups(spark: SparkSession) -> DataFrame:
    """grp, subject, ord: a row a subject of each group, in the order groups are looked up."""
    rows = [(g, s, k) for k, (g, ss) in enumerate(SUBJECT_GROUPS.items()) for s in ss]
    return spark.createDataFrame(rows, "grp string, subject string, ord int")


def normal_subject(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), " ", "_")


def of_group(rows: DataFrame, name: str, subject: str = "subject") -> DataFrame:
    """Rows whose subject is in the group, by name without regard to case; an unknown group has none."""
    found = next((g for g in SUBJECT_GROUPS if g.lower() == name.lower()), None)
    return rows.where(F.col(subject).isin(SUBJECT_GROUPS[found])) if found else rows.where("false")


def mapped_category(category: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_MAP.items() for x in kv])
    return F.coalesce(F.element_at(known, category), F.lit(DEFAULT_CATEGORY))


#: Levels of difficulty, and the colour of a model that has none of its own.
DIFFICULTIES = ["easy", "medium", "hard"]
NO_COLOUR = "#666666"


def of_difficulty(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Rows of these levels (column difficulty); unknown levels are ignored, and if none is known all rows stay."""
    known = [x for x in levels if x in DIFFICULTIES]
    return rows.where(F.col("difficulty").isin(known)) if known else rows


def toggled(excluded: DataFrame, models: DataFrame, name: str) -> DataFrame:
    """The excluded names (name) after one more switch of a model: one that was out is in again, one of the roster that was in is out, others change nothing."""
    one = models.where(F.col("name") == name).select("name").distinct()
    return excluded.select("name").distinct().join(one, "name", "left_anti").unionByName(one.join(excluded, "name", "left_anti"))


def without(models: DataFrame, excluded: DataFrame) -> DataFrame:
    return models.join(excluded.select("name"), "name", "left_anti")


def colour(model: Column, colours: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]) if colours else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(known, model), F.lit(NO_COLOUR))


def valid_choices(rows: DataFrame) -> DataFrame:
    """Multiple-choice rows (choices, labels) that have a right answer, with its place from 0."""
    ok = (F.size("choices") > 0) & (F.size("labels") > 0) & F.array_contains("labels", 1)
    return rows.where(ok).withColumn("correct_index", (F.array_position("labels", F.lit(1)) - 1).cast("int"))


def evaluation_tasks(judges: DataFrame, questions: DataFrame, modes: list[str]) -> DataFrame:
    """Every judge for every question in every mode: the work itself is this product, so a cross join of dimensions it is."""
    m = questions.sparkSession.createDataFrame([(x,) for x in modes], "mode string")
    return questions.crossJoin(F.broadcast(judges)).crossJoin(F.broadcast(m))


def nested_answers(answers: DataFrame) -> DataFrame:
    """One row a question with a map from model to answer, for export."""
    return answers.groupBy("q_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct("text", "in_tok", "out_tok"))))).alias("answers"))


def judge_row(models: DataFrame, name: str) -> DataFrame:
    """The first registry row of a name, without regard to case."""
    return models.where(F.lower("name") == name.lower()).orderBy("ordinal").limit(1)


def temperatures(models: DataFrame, overrides: dict[str, float], default: float) -> DataFrame:
    value = F.lit(default)
    for name, t in overrides.items():
        value = F.when(F.col("name") == name, t).otherwise(value)
    return models.select("name", value.cast("double").alias("temperature"))


def progress(done: Column, total: Column, width: int = 30) -> Column:
    """A bar such as [####------] 4/10 (40%)."""
    full = F.floor(F.coalesce(done * width / F.nullif(total, F.lit(0)), F.lit(0))).cast("int")
    share = F.floor(F.coalesce(done * 100 / F.nullif(total, F.lit(0)), F.lit(0))).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.lit("] "), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), share.cast("string"), F.lit("%)"))


#: Provider, parts of the model id of which one must occur, label.
REASONING = [
    ("google", ["thinking"], "thinking: OFF (disabled)"),
    ("openai", ["nano", "mini"], "reasoning: default (may use internal CoT)"),
    ("anthropic", [""], "extended thinking: OFF"),
    ("deepseek", [""], "reasoning: default (may use internal CoT)"),
]


def reasoning_label(provider: Column, model_id: Column) -> Column:
    """How a model reasons by its provider and id; "standard" where no rule fits."""
    rules = [F.when((provider == p) & F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(model_id, x)), label) for p, parts, label in REASONING]
    return F.coalesce(*rules, F.lit("standard"))
