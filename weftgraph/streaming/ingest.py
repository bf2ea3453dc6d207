"""Graph tables kept up to date from streams (an addition: the language itself knows no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.catalog import _upsert


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id", mode: str = "update") -> StreamingQuery:
    """Each micro-batch becomes a new version of the table in path/v=<batch>; readers take the newest.

    A replayed batch writes the same version again from the version before it, so results are exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if number:
            new = _upsert(spark.read.parquet(f"{path}/v={number - 1}"), new, [key], mode)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def degree_stream(edges: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Relationships per source and window of event time, with a watermark."""
    return edges.withWatermark(time, late).groupBy(F.window(time, width), "src").agg(F.count("*").alias("out_degree"))
