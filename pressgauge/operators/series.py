"""Operators on ordered series.

Series are aggregates with one row per period, so a series is never longer
than its calendar; windows are partitioned by the series keys. With no keys
there is a single series, and its few rows share one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions.columns import all_present, no_nan, safe_ratio
from pressgauge.functions.labels import lag_name

ONE_YEAR_OF_TRADING = 252


def ordered(keys: list[str], time: str):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time)


def moving_average(value: Column, keys: list[str], time: str, rows: int) -> Column:
    """Mean of up to ``rows`` rows ending here; short starts allowed."""
    return F.avg(value).over(ordered(keys, time).rowsBetween(1 - rows, 0))


def full_window(aggregate: Column, value: Column, keys: list[str], time: str, rows: int) -> Column:
    """An aggregate over ``rows`` rows, NULL unless all of them hold a value."""
    frame = ordered(keys, time).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) == rows, aggregate.over(frame))


def moving_zscore(value: Column, keys: list[str], time: str, rows: int = 12) -> Column:
    mean = full_window(F.avg(value), value, keys, time, rows)
    deviation = full_window(F.stddev_samp(value), value, keys, time, rows)
    return safe_ratio(value - mean, deviation)


def shifted(value: Column, keys: list[str], time: str, by: int) -> Column:
    """Value ``by`` rows earlier (later, when negative)."""
    return F.lag(value, by).over(ordered(keys, time))


def change_percent(value: Column, keys: list[str], time: str, rows: int = 12) -> Column:
    return (safe_ratio(value, shifted(value, keys, time, rows)) - 1) * 100


def difference(value: Column, keys: list[str], time: str, rows: int = 5) -> Column:
    return value - shifted(value, keys, time, rows)


def daily_return(value: Column, keys: list[str], time: str) -> Column:
    return safe_ratio(value, shifted(value, keys, time, 1)) - 1


def with_volatility(prices: DataFrame, price: str, keys: list[str], time: str, rows: int = 22) -> DataFrame:
    """Daily return and its annualised deviation over ``rows`` full rows, in %."""
    returns = prices.withColumn("ret", daily_return(F.col(price), keys, time))
    deviation = full_window(F.stddev_samp("ret"), F.col("ret"), keys, time, rows)
    return returns.withColumn("volatility", deviation * F.sqrt(F.lit(float(ONE_YEAR_OF_TRADING))) * 100)


def in_shock_zone(flag: Column, keys: list[str], time: str, rows: int = 30) -> Column:
    """Whether any of the previous 1..``rows`` rows was flagged."""
    seen = F.max(flag.cast("int")).over(ordered(keys, time).rowsBetween(-rows, -1))
    return F.coalesce(seen == 1, F.lit(False))


def base_index(series: DataFrame, value: str, keys: list[str], time: str, rows: int = 30) -> DataFrame:
    """Smoothed value indexed to 100 at the mean of its first ``rows`` values.

    Series whose reference is not positive are left out.
    """
    smooth = series.withColumn("smooth", moving_average(F.col(value), keys, time, rows))
    counted = smooth.withColumn("_n", F.count("smooth").over(ordered(keys, time)))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    reference = F.avg(F.when(F.col("_n") <= rows, F.col("smooth"))).over(whole)
    return (
        counted.withColumn("reference", reference)
        .filter(F.col("reference") > 0)
        .withColumn("indexed", F.col("smooth") / F.col("reference") * 100)
        .drop("_n")
    )


# -- Calendars ---------------------------------------------------------------

def calendar(series: DataFrame, keys: list[str], time: str, step: str = "interval 1 day") -> DataFrame:
    """Every period between the first and last of each series."""
    span = series.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(step))).alias(time))


def on_calendar(series: DataFrame, keys: list[str], time: str, step: str = "interval 1 day") -> DataFrame:
    return calendar(series, keys, time, step).join(series, [*keys, time], "left")


def forward_fill(value: Column, keys: list[str], time: str) -> Column:
    frame = ordered(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(frame)


def interpolated(series: DataFrame, value: str, keys: list[str], time: str) -> DataFrame:
    """Coarser series spread over days, linear between the known values."""
    days = on_calendar(series, keys, time)
    before = ordered(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    after = ordered(keys, time).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(time))
    marked = days.withColumns(
        {
            "_v0": F.last(value, ignorenulls=True).over(before),
            "_t0": F.last(known, ignorenulls=True).over(before),
            "_v1": F.first(value, ignorenulls=True).over(after),
            "_t1": F.first(known, ignorenulls=True).over(after),
        }
    )
    share = safe_ratio(F.datediff(time, "_t0"), F.datediff("_t1", "_t0"))
    blend = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.coalesce(share, F.lit(0.0))
    # Like the data-frame libraries, values past the last known one repeat it.
    return marked.withColumn(value, F.coalesce(blend, F.col("_v0"))).drop("_v0", "_v1", "_t0", "_t1")


def monthly_means(series: DataFrame, value: str, keys: list[str], time: str) -> DataFrame:
    """Mean per month start; months without rows stay, with NULL."""
    means = series.groupBy(*keys, F.trunc(time, "MM").alias(time)).agg(F.avg(value).alias(value))
    return on_calendar(means, keys, time, "interval 1 month")


# -- Correlation -------------------------------------------------------------

def lag_correlations(
    panel: DataFrame, x: str, y: str, keys: list[str], time: str, lags: range
) -> DataFrame:
    """corr(x shifted by lag, y) for every lag: (keys, ``lag``, ``corr``).

    All lags come from one sort per series and one aggregation.
    """
    window = ordered(keys, time)
    columns = [F.lag(x, lag).over(window).alias(f"_x{i}") for i, lag in enumerate(lags)]
    wide = panel.select(*keys, F.col(y).alias("_y"), *columns)
    pairs = [F.corr(f"_x{i}", "_y").alias(f"_c{i}") for i, _ in enumerate(lags)]
    rows = wide.groupBy(*keys).agg(*pairs)
    entries = [F.struct(F.lit(lag).alias("lag"), no_nan(F.col(f"_c{i}")).alias("corr")) for i, lag in enumerate(lags)]
    return rows.select(*keys, F.inline(F.array(*entries)))


def lag_matrix(correlations: DataFrame, keys: list[str], lags: range) -> DataFrame:
    """One row per series, one column per lag (``T-1``, ``T(0)``, ``T+1``)."""
    names = [lag_name(x) for x in lags]
    pivoted = correlations.groupBy(*keys).pivot("lag", list(lags)).agg(F.first("corr"))
    return pivoted.select(*keys, *[F.col(f"`{x}`").alias(n) for x, n in zip(lags, names)])


def best_lag(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """The lag with the largest absolute correlation; the smallest lag on ties."""
    rank = F.struct(F.abs("corr").alias("a"), (-F.col("lag")).alias("b"))
    known = correlations.filter(F.col("corr").isNotNull())
    return known.groupBy(*keys).agg(F.max_by(F.struct("lag", "corr"), rank).alias("_m")).select(*keys, "_m.lag", "_m.corr")


def best_predictor(correlations: DataFrame, keys: list[str], series: str) -> DataFrame:
    """Best (series, lag) per key by absolute correlation."""
    rank = F.struct(F.abs("corr").alias("a"), (-F.col("lag")).alias("b"), F.col(series).alias("c"))
    best = F.max_by(F.struct(series, "lag", "corr"), rank)
    return (
        correlations.filter(F.col("corr").isNotNull()).groupBy(*keys).agg(best.alias("_m")).select(*keys, "_m.*")
    )


def correlation_matrix(wide: DataFrame, names: list[str], keys: list[str] = []) -> DataFrame:
    """Pairwise-complete correlations as (keys, ``a``, ``b``, ``corr``) rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = wide.groupBy(*keys).agg(*[F.corr(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), no_nan(F.col(f"_c{i}")).alias("corr"))
        for i, (a, b) in enumerate(pairs)
        for p, q in dict.fromkeys([(a, b), (b, a)])
    ]
    return rows.select(*keys, F.inline(F.array(*entries)))


def autocorrelation(series: DataFrame, value: str, keys: list[str], time: str, max_lag: int = 40) -> DataFrame:
    """Autocorrelation around the global mean, with the 95 % band.

    Products with the shifted series come from one sort per series.
    """
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    centred = series.select(*keys, time, (F.col(value) - F.avg(value).over(whole)).alias("_d"))
    window = ordered(keys, time)
    lagged = centred.select(*keys, "_d", *[F.lag("_d", k).over(window).alias(f"_d{k}") for k in range(1, max_lag + 1)])
    total = F.sum(F.col("_d") * F.col("_d"))
    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(1.0).alias("_a0"),
        *[safe_ratio(F.sum(F.col("_d") * F.col(f"_d{k}")), total).alias(f"_a{k}") for k in range(1, max_lag + 1)],
    )
    entries = [F.struct(F.lit(k).alias("lag"), F.col(f"_a{k}").alias("acf")) for k in range(max_lag + 1)]
    return sums.select(*keys, (1.96 / F.sqrt("n")).alias("band"), F.inline(F.array(*entries)))


# -- Events ------------------------------------------------------------------

def with_extreme_flag(series: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Flag rows above the exact quantile of the whole series."""
    limit = series.agg(F.percentile(value, level)).scalar()
    return series.withColumn("is_extreme", F.coalesce(F.col(value) > limit, F.lit(False)))


def shock_volatility(series: DataFrame, volatility: str = "volatility") -> DataFrame:
    """Mean volatility inside and outside the shock zone, and the gap."""
    inside = F.avg(F.when(F.col("in_shock"), F.col(volatility)))
    outside = F.avg(F.when(~F.col("in_shock"), F.col(volatility)))
    return series.agg(
        F.sum(F.col("is_extreme").cast("int")).alias("shocks"),
        outside.alias("vol_calm"),
        inside.alias("vol_shock"),
        (inside - outside).alias("vol_gap"),
    )


# -- Alignment ---------------------------------------------------------------

def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on the period (and keys), complete rows only."""
    joined = left.join(right, keys)
    return joined.filter(all_present(joined.columns))


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keep all rows of ``left``."""
    return left.join(right, keys, "left")
