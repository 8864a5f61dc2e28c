"""What the operators of this subpackage share: tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = getattr(spark.sparkContext, "_echolith_dir", None)
    if made is None:
        made = spark.sparkContext._echolith_dir = tempfile.mkdtemp(prefix="echolith-")
    return made


def _written(spark: SparkSession) -> list[str]:
    """The shared tables that the session has written and not removed, oldest first."""
    context = spark.sparkContext
    if not hasattr(context, "_echolith_tables"):
        context._echolith_tables = []
    return context._echolith_tables


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there, so a lost executor costs no recomputation of what came before. The table stays until remove_tables."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def values(column: pa.Array, at_once: int = 200) -> Iterator:
    """A column's values one after the other, of which only a few are Python objects at a time: a batch of long texts isn't held twice."""
    for first in range(0, len(column), at_once):
        yield from column.slice(first, at_once).to_pylist()


def tables_mark(spark: SparkSession) -> int:
    """How many shared tables there are now."""
    return len(_written(spark))


def remove_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the session's shared tables written since a mark, but for the last keep. Results that read them must be written by then."""
    written = _written(spark)
    for path in written[since : len(written) - keep]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    del written[since : len(written) - keep]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the least node that it reaches.

    Alternating large-star and small-star rounds. A round is two aggregations (combined before they shuffle) and two joins on node ids whose hot keys adaptive execution can split, as each round reads a written table.
    """
    def summary(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    mark = tables_mark(edges.sparkSession)
    e = shared_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = summary(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = shared_table(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = shared_table(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "small")
        remove_tables(e.sparkSession, mark, 1)  # the rounds before this one
        now = summary(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
