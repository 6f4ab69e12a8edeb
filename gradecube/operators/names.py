"""Names of models: fuzzy match against a roster, and labels put back to models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Letters of the pieces by which names are looked up in a roster.
PIECE = 3


def pieces(text: Column, size: Column | int) -> Column:
    """The distinct runs of so many letters in a text; none if it is shorter."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, size if isinstance(size, Column) else F.lit(size))))).otherwise(F.array().cast("array<string>"))


def matched(names: DataFrame, roster: DataFrame) -> DataFrame:
    """name, model: equal after stripping blanks and brackets, else the first of the roster whose name contains it in lower case.

    Names are made distinct first. Both sides are cut into pieces of three letters (names of one or two letters are a
    piece themselves), and a name is looked up by the piece of its own that is rarest in the roster: whatever contains
    the name contains that piece. So a name meets few of the roster, however large. A name with nothing left of it
    fits the first of the roster, which alone has the empty piece; a null name has no model.
    """
    clean = F.regexp_replace(F.col("name"), r"^[\s\[\]]+|[\s\[\]]+$", "")
    n = names.select("name").distinct().withColumn("clean", clean).withColumn("low", F.lower("clean"))
    r = roster.select(F.col("name").alias("model"), "ordinal", F.lower("name").alias("held"))
    first = r.agg(F.min_by(F.struct("*"), "ordinal").alias("x")).where("x IS NOT NULL").select("x.*", F.lit("").alias("piece"))
    index = r.select("*", F.explode(F.concat(*[pieces(F.col("held"), k + 1) for k in range(PIECE)])).alias("piece")).unionByName(first)
    common = index.groupBy("piece").agg(F.count("*").alias("f"))
    cut = F.when(F.col("low") == "", F.array(F.lit(""))).otherwise(pieces(F.col("low"), F.least(F.lit(PIECE), F.length("low"))))
    own = n.where("low IS NOT NULL").select("name", "clean", "low", F.explode(cut).alias("piece"))
    rare = own.join(common, "piece", "left").groupBy("name", "clean", "low").agg(F.min_by("piece", "f").alias("piece"), F.count_if(F.col("f").isNull()).alias("strange")).where("strange = 0")
    met = rare.join(index, "piece").where(F.contains("held", "low"))
    best = met.groupBy("name").agg(F.min_by("model", F.struct((F.col("model") != F.col("clean")).cast("int").alias("e"), "ordinal")).alias("model"))
    return n.select("name").join(best, "name", "left")


def remapped(given: DataFrame, labels: DataFrame) -> DataFrame:
    """given (grp, label) to model by labels (grp, label, model): the same label, else the first that holds or is held by it."""
    a = given.select("grp", F.col("label").alias("given"))
    b = labels.select("grp", "label", "model", "ordinal")
    same = F.col("given") == F.col("label")
    held = F.contains(F.col("given"), F.col("label")) | F.contains(F.col("label"), F.col("given"))
    j = a.join(b, "grp").where(same | held).withColumn("_k", F.row_number().over(Window.partitionBy("grp", "given").orderBy(same.desc(), "ordinal")))
    return j.where("_k = 1").select("grp", "given", "model")
