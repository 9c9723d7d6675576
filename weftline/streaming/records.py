"""Canonical records as a stream: new JSONL files in a folder become valid, first-seen records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators.records import validity


def read(spark: SparkSession, folder: str, lateness: str = "7 days") -> DataFrame:
    """Valid records of the files that arrive in ``folder``, each record_id once within ``lateness`` of its arrival."""
    lines = spark.readStream.format("text").load(folder).withColumn("arrived", F.current_timestamp())
    rows = lines.select("arrived", F.from_json("value", schema.RECORD).alias("r")).where("r is not null").select("arrived", "r.*")
    valid = rows.where(validity().isNull())
    return valid.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["record_id"])


def write(stream: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the records to a parquet table; ``once`` ends after what is there now."""
    writer = stream.drop("arrived").writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
