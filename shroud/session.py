"""Spark session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "shroud", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and the character sets that old delimited files need."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def register(spark: SparkSession) -> None:
    """The engine's functions, for SQL."""
    from pyspark.sql.functions import pandas_udf

    from .functions import detect, generalize, text

    spark.udf.register("pii_matches", detect.matches_udf())
    spark.udf.register("pii_kind", pandas_udf(detect.kinds_of, "string"))
    for kind in generalize.SUPPORTED:
        spark.udf.register(f"generalize_{kind}", pandas_udf(generalize.python_of(kind), "string"))
    spark.udf.register("value_shape", pandas_udf(text.shapes_of, "string"))
    spark.udtf.register("pii_rows", detect.rows_udtf())
