"""Quotas, stratified samples, blind labels and shuffles; all orders are by md5 of seed and key, so any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def key(*parts: Column | str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def quota_table(rows: DataFrame, stratum: str, target: int, even: bool = False) -> DataFrame:
    """stratum, available and taken of each stratum, from its count by windows over the strata, which are few.

    Filled as water fills vessels: every stratum up to one level, the highest whole one whose volume is within the
    target, and one more from the first strata by name above it. Even: equal shares, one more from the first by name;
    what small strata leave is not handed on.
    """
    s = rows.groupBy(stratum).agg(F.count("*").alias("available"))
    every = Window.partitionBy()
    if even:
        name = F.row_number().over(Window.orderBy(stratum))
        share, rest = F.floor(F.lit(target) / F.count("*").over(every)), F.lit(target) % F.count("*").over(every)
        return s.select(stratum, "available", F.least("available", share + (name <= rest).cast("long")).cast("long").alias("taken"))
    up = Window.orderBy("available", stratum)
    below = F.sum("available").over(up.rowsBetween(Window.unboundedPreceding, -1))
    left = F.count("*").over(every) - F.row_number().over(up) + 1
    s = s.withColumn("_level", F.floor(F.greatest(F.lit(0), F.lit(target) - F.coalesce(below, F.lit(0))) / left))
    level = F.coalesce(F.max(F.when(F.col("_level") < F.col("available"), F.col("_level"))).over(every), F.max("available").over(every))
    s = s.withColumn("_base", F.least("available", level)).withColumn("_deep", F.col("available") > F.col("_base"))
    rest = F.lit(target) - F.sum("_base").over(every)
    first = F.row_number().over(Window.partitionBy("_deep").orderBy(stratum)) <= rest
    return s.select(stratum, "available", (F.col("_base") + (F.col("_deep") & first).cast("long")).cast("long").alias("taken"))


def sampled(rows: DataFrame, stratum: str, id_: str, quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """The first rows of each stratum in md5 order, as many as its quota (stratum, taken)."""
    w = Window.partitionBy(stratum).orderBy(key(F.col(id_).cast("string"), seed=seed))
    q = quotas.select(stratum, F.col("taken").alias("_quota"))
    return rows.join(q, stratum).withColumn("_k", F.row_number().over(w)).where("_k <= _quota").drop("_k", "_quota")


def stratified(rows: DataFrame, stratum: str, id_: str, target: int, even: bool = False) -> DataFrame:
    return sampled(rows, stratum, id_, quota_table(rows, stratum, target, even))


def spread(rows: DataFrame, stratum: str, id_: str, target: int) -> DataFrame:
    """One row of each of target strata in md5 order if strata outnumber the target, else even shares; then cut to the target in md5 order."""
    shares = quota_table(rows, stratum, target, even=True)
    first = F.row_number().over(Window.orderBy(key(F.col(stratum).cast("string")))) <= target
    many = F.count("*").over(Window.partitionBy()) > target
    quotas = shares.select(stratum, F.when(many, first.cast("long")).otherwise(F.col("taken")).alias("taken"))
    return sampled(rows, stratum, id_, quotas).orderBy(key(F.col(id_).cast("string"))).limit(target)


def blind_labels(cells: DataFrame, group: list[str], model: str) -> DataFrame:
    """Label "Response A" and so on, in md5 order of each group; after Z come AA, AB."""
    w = Window.partitionBy(*group).orderBy(key(*[F.col(g).cast("string") for g in group], F.col(model)))
    n = F.row_number().over(w) - 1
    letter = lambda x: F.char(F.lit(65) + x)
    label = F.when(n < 26, letter(n)).otherwise(F.concat(letter(F.floor(n / 26) - 1), letter(n % 26)))
    return cells.withColumn("label", F.concat(F.lit("Response "), label))


def shuffled_choices(choices: Column, id_: Column) -> tuple[Column, Column]:
    """The choices in md5 order, and the letter of the first one, which is right."""
    keyed = F.array_sort(F.transform(choices, lambda c: F.struct(key(id_, c).alias("k"), c.alias("c"))))
    order = F.transform(keyed, lambda x: x["c"])
    return order, F.char(F.lit(64) + F.array_position(order, F.get(choices, F.lit(0))))
