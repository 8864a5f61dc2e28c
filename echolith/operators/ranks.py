"""Exact ranks, percentiles and samples without putting a group's rows in one task.

Distinct values are counted, cut into buckets by approximate quantiles of their group, and numbered within buckets; bucket totals give the rest. The cuts only balance the work: the result is exact whatever they are. A group of any size is thus spread over BUCKETS tasks, and repeated values count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def group(by: list[str]) -> Column:
    """The columns by as one key that is never null: groups with null columns are groups like any other, in joins too."""
    return F.struct(*by) if by else F.lit(0)


def joined(left: DataFrame, right: DataFrame, by: list[str], more: list[str] | None = None, how: str = "inner") -> DataFrame:
    """left with right's further columns, by groups (nulls are equal) and the columns more (nulls are not)."""
    return left.withColumn("_group", group(by)).join(right.withColumn("_group", group(by)).drop(*by), ["_group", *(more or [])], how).drop("_group")


def positions(df: DataFrame, by: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """(by..., value, n, before): for each distinct value of a group, how many rows have it and how many have a smaller one. Null values are left out; NaN is the largest. Nulls in by form groups."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group(by).alias("_group"), value).agg(F.count("*").alias("n"))
    cuts = counted.groupBy("_group").agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000).alias("cuts"))
    placed = counted.join(cuts, "_group").withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    own = Window.partitionBy("_group", "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("inner", F.coalesce(F.sum("n").over(own), F.lit(0)))
    totals = placed.groupBy("_group", "bucket").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("_group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_group", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("earlier"))
    return inner.join(totals, ["_group", "bucket"]).select(*(F.col(f"_group.`{c}`").alias(c) for c in by), value, "n", (F.col("inner") + F.col("earlier")).alias("before"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by..., value, name): the rank of each distinct value, ties averaged, from 1."""
    return positions(df, by, value).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., one column a share): exact percentiles, linear between neighbours."""
    at = positions(df, by, value)
    sizes = at.groupBy(*by).agg(F.sum("n").alias("size"))
    at = joined(at, sizes, by)
    picked = []
    for name, p in shares.items():
        place = F.lit(p) * (F.col("size") - 1)
        for side, k in (("low", F.floor(place)), ("high", F.ceil(place))):
            picked.append(F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value))).alias(f"{name}_{side}"))
    out = at.groupBy(*by, "size").agg(*picked)
    part = lambda p: F.lit(p) * (F.col("size") - 1) - F.floor(F.lit(p) * (F.col("size") - 1))
    return out.select(*by, *((F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * part(p)).alias(k) for k, p in shares.items()))


def column_percentiles(df: DataFrame, by: list[str], columns: tuple[str, ...], share: float, suffix: str) -> DataFrame:
    """(by..., <column><suffix>...): one exact percentile of several columns, found together."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    found = percentiles(df.select(*by, cells.alias("cell")).select(*by, "cell.*"), [*by, "column"], "value", {"p": share})
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("column") == c, F.col("p"))).alias(f"{c}{suffix}") for c in columns))


def draw_key(*keys: Column, seed: int) -> Column:
    """A number that shuffles rows: the first 15 hexadecimal digits of an MD5, the same for the same keys and seed in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys, F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def draw(df: DataFrame, by: list[str], key: str, count: int | None = None, share: float | None = None) -> DataFrame:
    """The rows of each group with the smallest keys: count of them, or the whole part of share of the group. Keys should be distinct in a group; rows with equal keys go together."""
    at = positions(df, by, key)
    if count is None:
        sizes = at.groupBy(*by).agg(F.floor(F.sum("n") * F.lit(share)).alias("wanted"))
        at = joined(at, sizes, by)
    else:
        at = at.withColumn("wanted", F.lit(count))
    return joined(df, at.where("before + n <= wanted").select(*by, key), by, [key], "left_semi")


def shuffled(df: DataFrame, by: list[str], key: Column, seed: int) -> DataFrame:
    """df with place, each row's place from 0 in its group's order of draw keys, and size, the group's rows. Keys should be distinct in a group; rows with equal keys share a place."""
    keyed = df.withColumn("_key", draw_key(key, seed=seed))
    at = positions(keyed, by, "_key")
    at = joined(at.select(*by, "_key", F.col("before").alias("place")), at.groupBy(*by).agg(F.sum("n").alias("size")), by)
    return joined(keyed, at, by, ["_key"]).drop("_key")


def sample(df: DataFrame, by: list[str], key: Column, seed: int, share: float) -> DataFrame:
    """An exact share of each group, its number of rows rounded half to even, with place: the order that the draw gives them."""
    return shuffled(df, by, key, seed).where(F.col("place") < F.rint(F.lit(share) * F.col("size"))).drop("size")


def with_validation(df: DataFrame, by: list[str], key: Column, seed: int, share: float = 0.1) -> DataFrame:
    """df with validation: true for the last share of each group's shuffled rows, the others' number rounded down."""
    rows = shuffled(df, by, key, seed)
    return rows.withColumn("validation", F.col("place") >= F.floor(F.col("size") * F.lit(1 - share))).drop("place", "size")


def bernoulli(df: DataFrame, key: Column, seed: int, share: float) -> DataFrame:
    """Each row with probability share, fixed by key and seed."""
    return df.where(draw_key(key, seed=seed) < F.lit(int(share * 16**15)))


def chance(*keys: Column, seed: int, out_of: int, kept: int) -> Column:
    """True with probability kept / out_of, fixed by keys and seed."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(out_of)) < kept
