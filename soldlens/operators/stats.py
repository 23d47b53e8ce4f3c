"""Price statistics and series: exact percentiles, fences by group, native throughout.

One exchange by group gives the quartiles; they come back by a join on the group keys (few rows, so Catalyst broadcasts
them within its own size limit) instead of a window, which would sort every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soldlens.functions.dates import period_key
from soldlens.functions.money import with_shipping

UNKNOWN_CURRENCY = "UNKNOWN"
LEAST_TO_TRIM = 8


def currency_key(currency: Column) -> Column:
    return F.coalesce(F.upper(currency), F.lit(UNKNOWN_CURRENCY))


def fenced(rows: DataFrame, keys: Sequence[str], value: str = "value", trim: bool = True) -> DataFrame:
    """rows with n (the group's size) and kept: within 1.5 quartile ranges, in groups of 8 or more."""
    groups = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    joined = rows.join(groups, list(keys))
    inside = F.col(value).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    kept = (F.col("n") < LEAST_TO_TRIM) | inside if trim else F.lit(True)
    return joined.withColumn("kept", kept).drop("q")


def outliers(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The rows that trimming removes."""
    return fenced(rows, keys, value).where(~F.col("kept")).drop("kept", "n")


def price_stats(rows: DataFrame, keys: Sequence[str] = ("currency",), *, trim: bool = True, include_shipping: bool = False, scale: int = 2) -> DataFrame:
    """Per group: count, outliers_removed, min, max, mean, percentiles, first and last sold date, shipping_unknown.

    rows: the keys, price, shipping, sold_date. Groups have rows with a price only; money is rounded to `scale` places.
    """
    value = with_shipping(F.col("price"), F.col("shipping")) if include_shipping else F.col("price")
    unknown = F.col("shipping").isNull() if include_shipping else F.lit(False)
    priced = rows.where(F.col("price").isNotNull()).select(*keys, value.alias("value"), "sold_date", unknown.alias("unknown"))
    marks = (0.1, 0.25, 0.5, 0.75, 0.9)
    kept = F.col("kept")
    out = (
        fenced(priced, keys, trim=trim)
        .groupBy(*keys)
        .agg(
            F.count_if(kept).alias("count"),
            F.count_if(~kept).alias("outliers_removed"),
            F.min(F.when(kept, F.col("value"))).alias("min"),
            F.max(F.when(kept, F.col("value"))).alias("max"),
            F.avg(F.when(kept, F.col("value"))).alias("mean"),
            F.percentile(F.when(kept, F.col("value")), F.array(*map(F.lit, marks))).alias("p"),
            F.min(F.when(kept, F.col("sold_date"))).alias("first_sold"),
            F.max(F.when(kept, F.col("sold_date"))).alias("last_sold"),
            F.count_if(kept & F.col("unknown")).alias("shipping_unknown"),
        )
    )
    money = lambda c, name: F.round(c, scale).alias(name)
    names = ("p10", "p25", "median", "p75", "p90")
    return out.select(*keys, "count", "outliers_removed", *[money(F.col(c), c) for c in ("min", "max", "mean")], *[money(F.col("p")[i], n) for i, n in enumerate(names)], "first_sold", "last_sold", "shipping_unknown")


def in_order(stats: DataFrame) -> DataFrame:
    """Largest sample before trimming first, then by name."""
    return stats.orderBy((F.col("count") + F.col("outliers_removed")).desc(), "currency")


def price_series(rows: DataFrame, period: str, **options) -> DataFrame:
    """Statistics per period and currency, trimmed within each bucket, oldest first; rows without a date are left out."""
    key = period_key(F.col("sold_date"), period)
    dated = rows.where(F.col("sold_date").isNotNull()).withColumn("period", key)
    return price_stats(dated, ("period", "currency"), **options)


def most_recent_priced(rows: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The n most recent rows with a price, across all currencies, before any trimming."""
    if n < 0:
        raise ValueError("limit must not be negative")
    return rows.where(F.col("price").isNotNull()).orderBy(*order).limit(n)
