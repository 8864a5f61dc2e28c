"""Splits, eligibility and sweeps of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.operators.ranks import draw, draw_key, joined, positions
from echolith.schema import sweep_values

CATEGORIES = ("sintetica", "great_hall", "octagon", "classroom")


def category(name: Column) -> Column:
    """The first kind of response that the file name holds (case matters), else other."""
    out = F.when(name.contains(CATEGORIES[0]), CATEGORIES[0])
    for c in CATEGORIES[1:]:
        out = out.when(name.contains(c), c)
    return out.otherwise("other")


def pick(files: DataFrame, by: list[str], name: str, seed: int, count: int | None = None, share: float | None = None) -> DataFrame:
    """A fixed draw from each group: count files, or a share of them."""
    keyed = files.withColumn("_key", draw_key(F.col(name).cast("string"), seed=seed))
    return draw(keyed, by, "_key", count, share).drop("_key")


def with_split(files: DataFrame, by: list[str], name: str, seed: int, train_share: float = 0.8) -> DataFrame:
    """files with split: train for the whole part of train_share of each group, else test. A name that several groups hold is drawn in each by itself; rows that repeat in a group go together, in train only if all of them fit."""
    keyed = files.withColumn("_key", draw_key(F.coalesce(F.col(name).cast("string"), F.lit("")), seed=seed))
    at = positions(keyed, by, "_key")
    at = joined(at, at.groupBy(*by).agg(F.floor(F.sum("n") * F.lit(train_share)).alias("_wanted")), by)
    drawn = at.select(*by, "_key", F.when(F.col("before") + F.col("n") <= F.col("_wanted"), "train").otherwise("test").alias("split"))
    return joined(keyed, drawn, by, ["_key"]).drop("_key")


def eligible(rir: Column, chosen: Column, substring: bool = False) -> Column:
    """Whether a response is to be augmented: not synthetic, and among the chosen names (or, with substring, part of one)."""
    among = F.exists(chosen, lambda s: s.contains(rir)) if substring else F.array_contains(chosen, rir)
    return ~rir.contains("sintetica") & among


def sweep(df: DataFrame, column: str, start: float, stop: float, step: float) -> DataFrame:
    """df once for each value of a sweep."""
    return df.withColumn(column, F.explode(F.array(*(F.lit(v) for v in sweep_values(start, stop, step)))))


def with_values(df: DataFrame, values: DataFrame) -> DataFrame:
    """df once for each row of a small table, to which what depends on the values alone has been added."""
    return df.crossJoin(F.broadcast(values))


def members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key), key, "left_semi")


def non_members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """df without the keys of others; repeated rows stay."""
    return df.join(others.select(key), key, "left_anti")


def united(*lists: DataFrame) -> DataFrame:
    """The rows of all lists of files, as often as they occur; columns are matched by name."""
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out


def first_names(files: DataFrame, name: str, part: str, count: int) -> DataFrame:
    """The first count distinct names by code that hold part."""
    return files.where(F.col(name).contains(part)).select(name).distinct().orderBy(name).limit(count)


def within_split(responses: DataFrame, speech: DataFrame, salts: int = 32) -> DataFrame:
    """Every response with every speech file of its split. A split's responses are dealt to salts by a hash of their names and tags, each of which gets its speech, so that a split is not one task's."""
    names = [c for c, kind in responses.dtypes if not kind.startswith(("array", "map"))]
    dealt = responses.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)))
    copies = speech.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, ["split", "_salt"]).drop("_salt")


def partners(responses: DataFrame, speech: DataFrame, key: str, name: str) -> DataFrame:
    """(split, key, pairs, first_<name>): how many pairs within_split() makes of each key of responses, and the least name among its speech. Counts of both sides meet, not their rows, so the work grows with the rows and not with the pairs."""
    own = responses.groupBy("split", key).agg(F.count("*").alias("_own"))
    others = speech.groupBy("split").agg(F.count("*").alias("_others"), F.min(name).alias(f"first_{name}"))  # a row a split
    return own.join(F.broadcast(others), "split").select("split", key, (F.col("_own") * F.col("_others")).alias("pairs"), f"first_{name}")
