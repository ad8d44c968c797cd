"""Sessions with the settings that the library's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Time zone for timestamps; quoted identifiers as standard SQL has them; adaptive plans with skew handling.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "lodestone", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
