"""Session settings that suit the wide plans of this package."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The feature plans aggregate some sixty columns at once. A generated method over 8000 bytes
# is never compiled by the JVM, so Spark is told to split such stages; and one plan holds
# more generated classes than the default cache keeps.
WIDE_PLAN_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings to a session builder."""
    for key, value in WIDE_PLAN_CONF.items():
        builder = builder.config(key, value)
    return builder
