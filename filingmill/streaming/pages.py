"""Page cleaning over files that keep arriving: the batch functions, applied to a stream. No state is held, so nothing is
late; each file is cleaned once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.pages import PAGE, cleaned


def clean_arriving_pages(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Cleans what lies in the folder of page arrays now, and ends; run it again for what has come since."""
    pages = spark.readStream.schema(PAGE).option("multiLine", True).json(source).drop("_corrupt")
    out = cleaned(pages).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()


