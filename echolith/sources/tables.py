"""Record tables on disk: Parquet, partitioned by split and band, so that a scan for one of each opens nothing else."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from echolith.functions import kernels
from echolith.sources import formats

ROWS_A_FILE = 50_000
#: Columns of a file of measured descriptors.
MEASURED = "name string, band int, t30 double, c50 double, c80 double, d50 double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: a build that broke off has no success mark."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark))


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, place = _place(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table, if it is there."""
    fs, place = _place(spark, path)
    fs.delete(place, True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that spark.checkpoint.dir names, which driver and executors share. A local session without one gets a temporary folder; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{named or tempfile.mkdtemp(prefix='echolith-')}/{name}-{uuid.uuid4().hex}"


def shared(df: DataFrame, name: str) -> DataFrame:
    """df written to a work folder and read again: what comes after doesn't compute it twice, and a lost executor costs no recomputation."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_records(records: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE) -> None:
    records.write.mode("overwrite").partitionBy("type_data", "band").option("maxRecordsPerFile", rows_a_file).parquet(path)


def write_outcomes(outcomes: DataFrame, path: str, rows_a_file: int = ROWS_A_FILE) -> None:
    """Records and rejects in one pass: rows with the columns rejected, type_data and band, a partition for each."""
    outcomes.write.mode("overwrite").partitionBy("rejected", "type_data", "band").option("maxRecordsPerFile", rows_a_file).parquet(path)


def read_outcomes(spark: SparkSession, path: str, rejected: bool) -> DataFrame:
    """The records, or the rejects with their errors; the other kind's files aren't opened."""
    found = spark.read.parquet(path)
    found = found.where(found["rejected"] == rejected).drop("rejected")
    return found.select("type_data", "band", "speech_name", "rir_name", "aug_tag", "error") if rejected else found.drop("error")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results (band, ...) of an experiment, a partition a band: writing one band's again leaves the others."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("band").parquet(path)


def read_results(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """The results at path, of some bands if named; other bands' files aren't opened."""
    found = spark.read.parquet(path)
    return found.where(found["band"].isin(bands)) if bands else found


def filter_table(spark: SparkSession, bands: tuple[int, ...], fs: int, order: int, kind: str = "octave band") -> DataFrame:
    """(band, section, b0, b1, b2, a1, a2): each band's filter as second-order sections of gain 1 at the band's centre, for what filters sample by sample."""
    rows = [(b, i, *map(float, row)) for b in bands for i, row in enumerate(kernels.sections(order, *kernels.band_edges(b, fs, kind), fs, b))]
    return spark.createDataFrame(rows, "band int, section int, b0 double, b1 double, b2 double, a1 double, a2 double")


def read_measured(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Measured descriptors of rooms from CSV files with a header, or from a sheet of workbooks; a line or cell that doesn't fit has nulls."""
    if path.lower().endswith(".xlsx"):
        formats.register(spark)
        read = spark.read.format("workbook").schema(MEASURED)
        return (read.option("sheet", sheet) if sheet else read).load(path)
    return spark.read.csv(path, MEASURED, header=True, enforceSchema=False)


def cached_records(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, built by build() and written first unless it is there whole."""
    if not exists(spark, path):
        write_records(build(), path)
    return read_records(spark, path)
