"""File-stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import temporal, values
from ...operators import encode
from ...session import configure
from ...streaming.features import file_stream, run_once, with_frequencies
from .registry import query, r
from .storage import fresh


def _event_stream(spark, sf):
    schema = configure(spark).read.parquet(f"{sf}/events.parquet").schema
    return file_stream(spark, sf, schema, "events.parquet")


@query("stream_features", """
SELECT event_id AS id, CAST(hour(ts) IN (2, 3, 4) AS TINYINT) AS is_dawn, CAST(isodow(ts) IN (6, 7) AS TINYINT) AS is_weekend,
  CAST(floor(hour(ts) / 4) AS INTEGER) AS block FROM events""")
def stream_features(spark, sf):
    """The same row-local expressions on a stream."""

    def transform(df):
        hour = F.hour("ts")
        return df.select(
            F.col("event_id").alias("id"),
            temporal.is_dawn(hour).alias("is_dawn"),
            temporal.is_weekend(F.weekday("ts") + 1).alias("is_weekend"),
            values.safe_int(temporal.hour_block(hour)).alias("block"),
        )

    return run_once(_event_stream(spark, sf), transform, fresh(spark, "stream"), fresh(spark, "stream-state"))


@query("stream_frequencies", """
SELECT event_id AS id, round(count(*) OVER (PARTITION BY event_type) / CAST(count(*) OVER () AS DOUBLE), 6) AS event_type_freq FROM events""")
def stream_frequencies(spark, sf):
    """A stored frequency table joined to a stream of new rows."""
    known = encode.frequency_table(configure(spark).read.parquet(f"{sf}/events.parquet"), ["event_type"])

    def transform(df):
        rows = df.select(F.col("event_id").alias("id"), "event_type")
        return with_frequencies(rows, known, ["event_type"]).select("id", r("event_type_freq"))

    return run_once(_event_stream(spark, sf), transform, fresh(spark, "stream"), fresh(spark, "stream-state"))
