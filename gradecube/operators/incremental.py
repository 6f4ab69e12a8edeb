"""Resuming and merging of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def remaining(modes: DataFrame, done: DataFrame) -> DataFrame:
    return modes.select("mode").exceptAll(done.select("mode").distinct()).distinct()


def common(a: DataFrame, b: DataFrame, column: str = "model") -> DataFrame:
    return a.select(column).intersect(b.select(column))


def merged(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def append(df: DataFrame, path: str) -> None:
    """A checkpoint of finished rows, in folders by revision and mode; resume with to_do()."""
    df.write.mode("append").partitionBy(*[c for c in ("revision", "mode") if c in df.columns]).parquet(path)
