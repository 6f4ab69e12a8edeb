"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gradecube", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; ANSI mode stays on. Settings of the cluster win over these only if passed."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    b = SparkSession.builder.appName(name)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
