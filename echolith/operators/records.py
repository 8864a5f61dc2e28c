"""Questions asked of a record table: one row per name and band, with descriptors as columns."""

from __future__ import annotations

from math import lgamma

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from echolith.functions.arrays import half_even
from echolith.operators.ranks import average_ranks, column_percentiles, joined, percentiles

DESCRIPTORS = ("t30", "c50", "c80", "d50")
ROOMS = ("great_hall", "octagon", "classroom")


def scan(records: DataFrame, band: int, split: str) -> DataFrame:
    return records.where((F.col("band") == band) & (F.col("type_data") == split))


def band_summary(records: DataFrame, columns: tuple[str, ...] = DESCRIPTORS) -> DataFrame:
    """Per band: rows, and each column's 95th percentile, largest and smallest value, rounded half to even."""
    out = records.groupBy("band").agg(F.count("*").alias("rows"), *(f(c).alias(f"{c}_{k}") for c in columns for k, f in (("max", F.max), ("min", F.min))))
    out = joined(out, F.broadcast(column_percentiles(records, ["band"], columns, 0.95, "_p95")), ["band"])  # a row a band
    return out.select("band", "rows", *(half_even(F.col(f"{c}_{k}")).alias(f"{c}_{k}") for c in columns for k in ("p95", "max", "min")))


def box_plot(records: DataFrame, column: str, by: str = "band") -> DataFrame:
    """Quartiles, and whiskers: the outermost values within 1.5 interquartile ranges of the box."""
    q = percentiles(records, [by], column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    near = joined(records, F.broadcast(q), [by]).where(F.col(column).between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    return near.groupBy(by, "q1", "median", "q3").agg(F.min(column).alias("low"), F.max(column).alias("high"))


def room(name: Column, tag: str = "original") -> Column:
    """The first room that the name of an unaugmented record holds, else null."""
    out, original = None, name.contains(tag)
    for r in ROOMS:
        fits = name.contains(r) & original
        out = F.when(fits, r) if out is None else out.when(fits, r)
    return out


def room_statistics(records: DataFrame, column: str = "t30") -> DataFrame:
    """Per room and band: mean and population deviation over unaugmented records."""
    rooms = records.withColumn("room", room(F.col("name"))).where("room is not null")
    return rooms.groupBy("room", "band").agg(F.count("*").alias("rows"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))


def mid_band(records: DataFrame, columns: tuple[str, ...] = ("t30", "drr"), bands: tuple[int, int] = (500, 1000)) -> DataFrame:
    """Per name that has both bands: each column's mean over them."""
    both = records.where(F.col("band").isin(*bands)).groupBy("name").agg(*(F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{c}_{b}") for c in columns for b in bands))
    both = both.where(" and ".join(f"{c}_{b} is not null" for c in columns for b in bands))
    return both.select("name", *(((F.col(f"{c}_{bands[0]}") + F.col(f"{c}_{bands[1]}")) / 2).alias(f"{c}_mid") for c in columns))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., rows, rho): rank correlation, ties averaged; NaN where a side doesn't vary."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = joined(joined(df, average_ranks(df, by, "_x", "rx"), by, ["_x"]), average_ranks(df, by, "_y", "ry"), by, ["_y"])
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))  # corr() itself divides by zero, an error in ANSI mode
    return ranked.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(rho, F.lit(float("nan"))).alias("rho"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    from math import exp, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def with_p_value(correlations: DataFrame) -> DataFrame:
    """correlations with p, two-sided by the t distribution with rows - 2 degrees of freedom; NaN where rho is, null under 3 rows otherwise."""

    @pandas_udf("double")
    def p(rho, rows):
        def one(r: float, n: float) -> float | None:
            if r is None or r != r or n < 3:
                return None
            return 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)  # x = dof / (dof + t²)

        return rho.combine(rows, one).astype(float)

    return correlations.withColumn("p", F.when(F.isnan("rho"), F.lit(float("nan"))).otherwise(p("rho", "rows")))


def subset(name: Column) -> Column:
    """What kind of response a record comes from."""
    low = F.lower(name)
    return F.when(low.contains("sintetica"), "synthetic").when(low.rlike("tr_var_|drr_var_"), "augmented").otherwise("real")


def normalised(records: DataFrame, columns: tuple[str, ...] = DESCRIPTORS) -> DataFrame:
    """records with each column divided by its band's 95th percentile over all records, train and test."""
    out = joined(records, F.broadcast(column_percentiles(records, ["band"], columns, 0.95, "_p95")), ["band"])  # a row a band
    return out.select(*[c for c in records.columns if c not in columns], *((F.col(c) / F.nullif(f"{c}_p95", F.lit(0.0))).alias(c) for c in columns))


def prediction_errors(predicted: DataFrame, truth: DataFrame, keys: list[str], columns: tuple[str, ...] = DESCRIPTORS) -> DataFrame:
    """(keys..., err_<column>...): prediction less the rounded truth, rounded; joined by key."""
    t = truth.select(*keys, *(F.col(c).alias(f"true_{c}") for c in columns))
    return predicted.join(t, keys).select(*keys, *(half_even(F.col(c) - half_even(F.col(f"true_{c}"))).alias(f"err_{c}") for c in columns))


def results(predicted: DataFrame, truth: DataFrame, keys: list[str], columns: tuple[str, ...] = DESCRIPTORS) -> DataFrame:
    """(keys..., predicted_<column>..., true_<column>..., err_<column>...): what an experiment keeps of each prediction; joined by key."""
    p = predicted.select(*keys, *(F.col(c).alias(f"predicted_{c}") for c in columns))
    t = truth.select(*keys, *(half_even(F.col(c)).alias(f"true_{c}") for c in columns))
    errors = (half_even(F.col(f"predicted_{c}") - F.col(f"true_{c}")).alias(f"err_{c}") for c in columns)
    return p.join(t, keys).select(*keys, *(f"{k}_{c}" for k in ("predicted", "true") for c in columns), *errors)


def head(rows: DataFrame, by: list[str], count: int = 5) -> DataFrame:
    """The first count rows in order of by: a top-k in each task, then of those."""
    return rows.orderBy(*by).limit(count)


def best_epoch(history: DataFrame, by: list[str], loss: str = "val_loss", epoch: str = "epoch") -> DataFrame:
    """(by..., best_epoch, best_loss, epochs): the first epoch with the smallest loss."""
    return history.groupBy(*by).agg(F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss"), F.count("*").alias("epochs"))


def with_measured(estimates: DataFrame, measured: DataFrame) -> DataFrame:
    """Estimates and measurements in one table, sorted by band and name; columns of one side only are null on the other."""
    return estimates.unionByName(measured, allowMissingColumns=True).orderBy("band", "name")


def summary_frame(records: DataFrame, columns: tuple[str, ...] = DESCRIPTORS) -> DataFrame:
    """(band, measure, statistic, value): the band summary as one row a number."""
    wide = band_summary(records, columns)
    cells = [F.struct(F.lit(c).alias("measure"), F.lit(k).alias("statistic"), F.col(f"{c}_{k}").alias("value")) for c in columns for k in ("p95", "max", "min")]
    return wide.select("band", F.explode(F.array(*cells)).alias("cell")).select("band", "cell.*")
