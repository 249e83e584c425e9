"""Incremental preparation: new raw files are prepared once, and a stopped run goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kinfold.operators import records
from kinfold.sources.tables import RAW_SCHEMA


def prepare_new_files(spark: SparkSession, raw: str, out: str, state: str, source: str, split: str) -> None:
    """Prepare every tab-separated file under ``raw`` that no earlier run committed; the stream's checkpoint in ``state`` remembers them."""
    stream = spark.readStream.schema(RAW_SCHEMA).option("sep", "\t").option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(raw)
    ready = records.prepare(stream.na.fill("")).selectExpr("*", f"'{source}' AS source", f"'{split}' AS split")
    ready.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).partitionBy("split", "source", "country_norm").trigger(availableNow=True).start().awaitTermination()
