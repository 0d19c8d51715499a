"""Exact statistics over unique facts; money is decimal throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import price_per_area


def exact_mean(value: Column, total: Column | None = None, n: Column | None = None) -> Column:
    """Rounded once: avg() of decimals would round twice. total and n stand for the sum and the count of weighted values."""
    return F.round((F.sum(value) if total is None else total) / F.nullif(F.count(value) if n is None else n, F.lit(0)), 2)


def exact_median(value: Column, weight: Column | int = 1) -> Column:
    """Interpolated in doubles and then rounded as a decimal."""
    return F.round(F.percentile(value.cast("double"), F.lit(0.5), weight).cast("decimal(18,4)"), 2)


def usable() -> Column:
    return F.col("price").isNotNull() & (F.col("area") > 0)


def statistics(facts: DataFrame, *by: str, ids: str | None = None, weight: str | None = None) -> DataFrame:
    """count, mean of per-record values, weighted mean of raw sums, median and range of unique facts (price, area);
    weight names the number of equal facts that a row stands for."""
    each = facts.where(usable()).withColumn("value", price_per_area(F.col("price"), F.col("area")))
    total = lambda x, kind: (F.sum(x) if weight is None else F.sum(F.col(x) * F.col(weight).cast("decimal(12,0)"))).cast(kind)
    n = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("long"))
    measures = [
        n.alias("n"),
        exact_mean(F.col("value"), total("value", "decimal(24,2)"), n).cast("double").alias("mean"),
        F.round(total("price", "decimal(28,2)") / F.nullif(total("area", "decimal(22,2)"), F.lit(0).cast("decimal(22,2)")), 2).cast("double").alias("weighted"),
        exact_median(F.col("value"), 1 if weight is None else F.col(weight)).cast("double").alias("median"),
        F.min("value").cast("double").alias("least"),
        F.max("value").cast("double").alias("most"),
    ]
    if ids:
        measures.append(F.array_sort(F.collect_list(ids)).alias("ids"))
    return each.groupBy(*by).agg(*measures) if by else each.agg(*measures)


def eligible(occurrences: DataFrame, condition: Column, keys: list[str]) -> DataFrame:
    """Distinct keys of the facts that some matching occurrence names."""
    return occurrences.where(condition).select(*keys).distinct()


def distinct_values(occurrences: DataFrame, attribute: str, keys: list[str]) -> DataFrame:
    """How many facts each value of an attribute has, most first; nulls are no value."""
    counted = occurrences.where(F.col(attribute).isNotNull()).select(attribute, *keys).distinct().groupBy(F.col(attribute).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "value")


def coverage_gap(occurrences: DataFrame, verified: Column, awaiting: Column, keys: list[str]) -> DataFrame:
    """Facts that wait for review and have no verified occurrence."""
    return eligible(occurrences, awaiting, keys).join(eligible(occurrences, verified, keys), keys, "left_anti")


def conflict_count(occurrences: DataFrame, conflict: Column, keys: list[str]) -> DataFrame:
    return occurrences.where(conflict).select(*keys).distinct().agg(F.count(F.lit(1)).alias("conflicts"))


def largest_partition(records: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent combination of keys, the least of equals."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(1)


def evaluation_summary(results: DataFrame, sets: list[list[str]], measures: dict[str, Column], latency: str) -> DataFrame:
    """Rates and interpolated latency percentiles of results for each combination of columns in sets, in one pass.

    measures are booleans whose nulls don't count, such as a check that only some
    results have; each gives a rate and the number of results behind it. level
    tells a column's own null (bit 0) from a row over all its values (bit 1).
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rated = results.select(*columns, latency, *(m.cast("boolean").alias(f"m_{n}") for n, m in measures.items()))
    aggregates = [F.count(F.lit(1)).alias("results")]
    for n in measures:
        aggregates += [F.round(F.count_if(f"m_{n}") / F.nullif(F.count(f"m_{n}"), F.lit(0)), 6).alias(f"{n}_rate"), F.count(f"m_{n}").alias(f"{n}_of")]
    aggregates += [F.round(F.percentile(F.col(latency).cast("double"), F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 95)]
    grouped = rated.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns))
    return grouped.agg(F.grouping_id(*columns).cast("long").alias("level"), *aggregates).select("level", *columns, *(n for n in ("results", *(f"{m}_{k}" for m in measures for k in ("rate", "of")), "p50", "p95")))
