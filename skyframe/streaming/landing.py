"""Tables that arrive as files in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.fits import register


def stream_fits(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New files of the folder in order of name; the schema is that of the first, which must be there."""
    register(spark)
    r = spark.readStream.format("fits")
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)
