"""Incremental ingest (an extension): files that arrive in a landing folder become chunks of their repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodeseam.operators import chunks as C
from lodeseam.operators import windows as W

FILES = "repository_id string, file_path string, language string, content string"


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of source files, each read once."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", 64).parquet(folder)


def write_chunks(files: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Chunks of each batch, written below ``table`` by batch and repository. A batch that is run again writes over what
    it wrote before, so that a lost executor or driver leaves no chunk twice."""

    def write(batch: DataFrame, number: int) -> None:
        W.split(C.route(batch)).write.mode("overwrite").partitionBy("repository_id").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
