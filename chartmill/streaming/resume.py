"""Incremental generation as a stream over arriving files: an extension of append-and-resume.

The checkpoint replaces the scan for done ids; every micro-batch appends whole files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.generation import Generator, echo, generate


def generate_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, system: str, template: str, call: Generator = echo) -> StreamingQuery:
    """Generate for the JSON files (id, text) that arrive in source; processes what is there and ends."""
    rows = spark.readStream.schema("id string, text string").json(source)
    out = generate(rows, system, template, call)
    return out.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
