"""The analysis of a validation as one document, written beside its text and taken from its file while that is current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special, stats
from ..operators.benchmark import conclusion
from ..operators.inference import mid_rank

ROW = "model STRING, peer DOUBLE, truth DOUBLE, accuracy DOUBLE, peer_rank BIGINT, truth_rank DOUBLE, diff DOUBLE, truth_low DOUBLE, truth_high DOUBLE"
DOCUMENT = (
    "revision STRING, n_models BIGINT, questions BIGINT,"
    " correlation STRUCT<pearson: DOUBLE, low: DOUBLE, high: DOUBLE, p: DOUBLE, spearman: DOUBLE, spearman_p: DOUBLE, r2: DOUBLE, strength: STRING>,"
    " agreement STRUCT<exact: BIGINT, within_1: BIGINT, mean_diff: DOUBLE, max_diff: DOUBLE>,"
    " over_rated STRUCT<model: STRING, diff: DOUBLE>, under_rated STRUCT<model: STRING, diff: DOUBLE>,"
    " accuracy STRUCT<mean: DOUBLE, sd: DOUBLE, least: DOUBLE, most: DOUBLE>, conclusion STRING,"
    f" comparison ARRAY<STRUCT<{ROW.replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT')}>>"
)


def document(c: DataFrame, revision: str) -> DataFrame:
    """One row (DOCUMENT) from one pass over a comparison, as benchmark.comparison() gives it; no models give no row."""
    low, high = stats.wilson(F.col("correct"), F.col("total"))
    diff = F.col("peer") - F.col("truth")
    r = c.select("*", low.alias("truth_low"), high.alias("truth_high"), mid_rank(F.col("peer")).alias("rx"), F.abs("rank_diff").alias("off"), diff.alias("diff"))
    shown = F.struct("peer_rank", "model", F.round("peer", 4).alias("peer"), "truth", "accuracy", F.col("truth_rank").cast("double").alias("truth_rank"), F.round("diff", 4).alias("diff"), "truth_low", "truth_high")
    furthest = lambda sign: F.max_by(F.struct("model", F.round("diff", 4).alias("diff")), F.struct(sign * F.col("diff"), -F.col("model_ord")))
    one = r.agg(
        F.count("*").alias("n_models"),
        F.max("total").alias("questions"),
        F.round(stats.pearson("peer", "truth"), 6).alias("pearson"),
        F.round(stats.pearson("rx", "truth_rank"), 6).alias("spearman"),
        F.struct(F.count_if(F.col("off") < 0.5).alias("exact"), F.count_if(F.col("off") <= 1.5).alias("within_1"), F.round(F.avg("off"), 4).alias("mean_diff"), F.max("off").cast("double").alias("max_diff")).alias("agreement"),
        furthest(1.0).alias("over_rated"),
        furthest(-1.0).alias("under_rated"),
        F.struct(F.round(F.avg("accuracy"), 4).alias("mean"), F.round(F.stddev_pop("accuracy"), 4).alias("sd"), F.min("accuracy").alias("least"), F.max("accuracy").alias("most")).alias("accuracy"),
        F.count_distinct("truth").alias("truths"),
        F.array_sort(F.collect_list(shown)).alias("comparison"),
    ).where("n_models > 0")
    n = F.col("n_models").cast("double")
    one = one.select("*", special.pearson_p("pearson", n).alias("p"), special.pearson_p("spearman", n).alias("spearman_p"))
    ends = stats.fisher(F.col("pearson"), F.col("n_models"))
    correlation = F.struct("pearson", ends[0].alias("low"), ends[1].alias("high"), "p", "spearman", "spearman_p", F.round(F.col("pearson") * F.col("pearson"), 6).alias("r2"), stats.strength(F.col("pearson")).alias("strength"))
    names = [x.strip().split()[0] for x in ROW.split(",")]
    rows = F.transform("comparison", lambda x: F.struct(*[x[name].alias(name) for name in names]))
    return one.select(F.lit(revision).alias("revision"), "n_models", "questions", correlation.alias("correlation"), "agreement", "over_rated", "under_rated", "accuracy", conclusion(F.col("pearson"), F.col("p"), F.col("truths")).alias("conclusion"), rows.alias("comparison"))


def text(doc: DataFrame, title: str) -> DataFrame:
    """The document as a report, one row with a column value."""
    c = lambda name: F.col(name)
    line = lambda form, *cells: F.format_string(form, *cells)
    rows = F.transform("comparison", lambda x: F.format_string("  %-5d %-25s %7.2f %7.2f %+7.2f %7.1f  [%.3f, %.3f]", x["peer_rank"], x["model"], x["peer"], x["truth"], x["diff"], x["truth_rank"], x["truth_low"], x["truth_high"]))
    right = F.transform(F.sort_array(F.transform("comparison", lambda x: F.struct(x["accuracy"].alias("accuracy"), x["model"].alias("model"))), asc=False), lambda x: F.format_string("  %-25s %6.1f%%", x["model"], x["accuracy"]))
    parts = [
        line(f"# {title}\n\nRevision %s, %d models, %d questions\n\n## Correlation\n", c("revision"), c("n_models"), c("questions")),
        line("  Pearson r %.4f [%.4f, %.4f], p %.4f\n  Spearman rho %.4f, p %.4f\n  %s; %.1f%% of the variance explained\n\n## Scores\n", *[c(f"correlation.{k}") for k in ("pearson", "low", "high", "p", "spearman", "spearman_p", "strength")], c("correlation.r2") * 100),
        line("  %-5s %-25s %7s %7s %7s %7s  %s", *map(F.lit, ("Rank", "Model", "Peer", "Truth", "Diff", "T.rank", "Truth interval"))),
        F.array_join(rows, "\n"),
        line("\n## Rank agreement\n\n  Same rank %d of %d, within one %d; mean difference %.2f, largest %.1f", c("agreement.exact"), c("n_models"), c("agreement.within_1"), c("agreement.mean_diff"), c("agreement.max_diff")),
        line("  Most overrated %s (%+.2f), most underrated %s (%+.2f)\n\n## Accuracy\n", c("over_rated.model"), c("over_rated.diff"), c("under_rated.model"), c("under_rated.diff")),
        line("  Mean %.1f%%, deviation %.1f%%, from %.0f%% to %.0f%%", c("accuracy.mean"), c("accuracy.sd"), c("accuracy.least"), c("accuracy.most")),
        F.array_join(right, "\n"),
        line("\n## Conclusion\n\n  Peer scores: %s", c("conclusion")),
    ]
    return doc.select(F.concat_ws("\n", *parts).alias("value"))


def save(doc: DataFrame, folder: str, title: str) -> None:
    """One JSON document in folder/summary and its text in folder/report."""
    doc.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/summary")
    text(doc.sparkSession.read.schema(DOCUMENT).json(f"{folder}/summary"), title).coalesce(1).write.mode("overwrite").text(f"{folder}/report")


def changed(spark: SparkSession, path: str) -> object | None:
    """When the newest file under a path was changed, by the listing alone; nothing there gives None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max("modificationTime")).first()[0]


def kept(spark: SparkSession, folder: str, inputs: list[str], make: Callable[[], DataFrame], title: str) -> DataFrame:
    """The document of a folder if it is there and none of its inputs is newer; else it is made and saved first.

    Inputs that are gone do not make a document old.
    """
    at = changed(spark, f"{folder}/summary")
    if at is None or any(t and t > at for t in (changed(spark, p) for p in inputs)):
        save(make(), folder, title)
    return spark.read.schema(DOCUMENT).json(f"{folder}/summary")


def comparison(doc: DataFrame) -> DataFrame:
    """The models of a document, each a row with the document's figures."""
    return doc.select("*", F.explode("comparison").alias("c")).select("c.*", *[x for x in doc.columns if x not in ("comparison", "accuracy")], F.col("accuracy").alias("accuracies"))

