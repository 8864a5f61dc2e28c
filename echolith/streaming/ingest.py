"""New audio files as they arrive: the batch decoder over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echolith.schema import FS, SECONDS
from echolith.sources.audio import decoded

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def audio_stream(spark: SparkSession, folder: str, fs: int = FS, seconds: float = SECONDS, files_a_batch: int = 1000) -> DataFrame:
    """A stream of (path, name, fs, x, error), one row per new file. Row-wise, so it keeps no state."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.wav").option("maxFilesPerTrigger", files_a_batch)
    return decoded(reader.load(folder), fs, seconds)


def ingest(signals: DataFrame, path: str, checkpoint: str):
    """Write a stream of signals as Parquet, all files there are so far; returns the query."""
    return signals.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
