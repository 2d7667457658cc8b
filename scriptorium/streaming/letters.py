"""Letters as they arrive: fields for each new letter text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import fields
from ..profile import HEBREW, Profile

SCHEMA = "doc_id string, raw string, readable string"


def stream_fields(spark: SparkSession, source: str, sink: str, checkpoint: str, profile: Profile = HEBREW) -> StreamingQuery:
    """Read letter texts (parquet) from a folder as they come and append long fields.
    Fields need one letter at a time, so the stream has no state."""
    texts = spark.readStream.schema(SCHEMA).parquet(source)
    rows = fields.fields_long(fields.request_fields(texts, profile), profile)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
