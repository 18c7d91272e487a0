"""The stateless operators over a stream of documents, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brevis.functions import text as T
from brevis.operators import segment


def stream_segments(spark: SparkSession, path: str, schema: str, budget: int = 478) -> DataFrame:
    """Segments of Parquet documents as they arrive below ``path``."""
    docs = spark.readStream.schema(schema).parquet(path).withColumn("sents", T.sentences(F.col("text"), 5))
    return segment.explode_segments(segment.pack_sentences(docs, "sents", budget), ["doc_id"])


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived since the last run, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
