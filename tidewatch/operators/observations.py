"""Long observations with group maps, their duplicates, their wide store and its cache.

An observation is (metric_name, date, time_bucket, group, group_key, value, metadata). A map cannot be a key in Spark, so
group_key is the group as JSON with its keys in order. Group columns that are null are left out of the group.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIMENSIONS = ("date", "timeBucket", "bucketSize", "sym", "groupType", "groupValue")
#: Group keys that name one symbol, for overviews and (in order of priority) for symbol pages.
SYMBOL_KEYS = ("sym", "symbol", "ticker", "ric", "isin")
SYMBOL_PAGE_KEYS = ("symbol", "ticker", "security_code", "sym")
DRILLDOWN_KEYS = ("topixCapGrp", "market_cap_bucket", "market_segment", "segment", "sector")


def group_map(columns: list[str] | tuple[str, ...]) -> Column:
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def group_key(group: Column) -> Column:
    """Canonical text of a group: equal for equal groups whatever the order of their keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(group))))


def to_observations(
    facts: DataFrame, metrics: list[str], group_by: tuple[str, ...] = ("sym",), metadata: tuple[str, ...] = (), carried: dict[str, str] | None = None,
) -> DataFrame:
    """Long rows of a fact table, one per metric; further columns named in metadata go to the metadata map.

    carried names, for a metric, the column that tells which rows carry it; a metric without one is in every row.
    """
    flags = {m: F.coalesce(F.col(carried[m]), F.lit(False)) if carried and m in carried else F.lit(True) for m in metrics}
    wide = facts.select(
        "date", "time_bucket", group_map(group_by).alias("group"), group_map(metadata).alias("metadata"),
        F.array(*[F.when(flags[m], F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("value"))) for m in metrics]).alias("facts"))
    rows = wide.select("date", "time_bucket", "group", "metadata", group_key(F.col("group")).alias("group_key"), F.inline(F.array_compact("facts")))
    return rows.select("metric_name", "date", "time_bucket", "group", "group_key", "value", "metadata")


#: Columns of reversion facts that go to the metadata of their observations, and the one that may.
REVERSION_METADATA = ("horizon_sort_order", "trade_count", "notional", "positive_reversion_ratio", "valid_primary_quote_ratio")
REVERSION_OPTIONAL = ("context_sort_order",)


def reversion_observations(facts: DataFrame, group_by: tuple[str, ...] = ("sym",)) -> DataFrame:
    """Observations of reversion facts: one metric per horizon, the group led by venue and horizon.

    The metadata holds what REVERSION_METADATA and, where the facts have it, REVERSION_OPTIONAL name.
    """
    named = facts.withColumn("metric_name", F.concat(F.lit("primary_quote_reversion_"), "horizon", F.lit("_bps")))
    rest = (*REVERSION_METADATA, *[c for c in REVERSION_OPTIONAL if c in facts.columns])
    rows = named.select("metric_name", "date", "time_bucket", group_map(("venue", "horizon", *group_by)).alias("group"),
                        F.col("primary_quote_reversion_bps").alias("value"), group_map(rest).alias("metadata"))
    return rows.select("metric_name", "date", "time_bucket", "group", group_key(F.col("group")).alias("group_key"), "value", "metadata")


@dataclass(frozen=True)
class OutputContract:
    """Columns that a fact table must have, in the order of a report, and those that it may have; further ones are allowed."""

    value: str
    base: tuple[str, ...] = ("date", "time_bucket")
    group: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.base, *self.group, self.value, *self.metadata)))

    @property
    def documented(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.required, *self.optional)))

    def check(self, df: DataFrame) -> DataFrame:
        """df as it is; raises where required columns are missing."""
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"result of {self.value} lacks: {', '.join(missing)}")
        return df

    def select(self, df: DataFrame) -> DataFrame:
        """The documented columns of df, in order, then its further ones."""
        known = [c for c in self.documented if c in self.check(df).columns]
        return df.select(*known, *[c for c in df.columns if c not in known])


def output_contract(metric: str, group_by: tuple[str, ...] = ()) -> OutputContract:
    """The contract of a metric's fact table; reversion facts also have venue and horizon, and metadata."""
    if metric.startswith("primary_quote_reversion_"):
        return OutputContract(metric, ("date", "time_bucket", "venue", "horizon"), tuple(group_by), REVERSION_METADATA, REVERSION_OPTIONAL)
    return OutputContract(metric, group=tuple(group_by))


def require_output(df: DataFrame, metric: str, group_by: tuple[str, ...] = ()) -> DataFrame:
    """df as it is; raises where columns of the metric's output contract are missing."""
    return output_contract(metric, group_by).check(df)


def _checked(obs: DataFrame, good: Column, message: str) -> DataFrame:
    """Fails the query, when values are read, at a row that is not good.

    The check is part of the value, not of a key: the optimizer tries predicates on keys with nulls.
    """
    failed = F.raise_error(F.concat(F.lit(message), F.coalesce("metric_name", F.lit("null"))))
    return obs.withColumn("value", F.when(F.coalesce(good, F.lit(False)), F.col("value")).otherwise(failed))


def require_reversion(obs: DataFrame) -> DataFrame:
    """Rows pass as they are; one of another metric, or without venue or horizon, fails the query."""
    group = F.col("group")
    good = F.col("metric_name").startswith("primary_quote_reversion_") & (group["venue"] != "") & (group["horizon"] != "")
    return _checked(obs, good, "no reversion observation: ")


def field(name: str) -> Column:
    """A comparable key of an observation: a column, or an entry of its group or metadata; null where it has none."""
    if name in ("metric_name", "date", "time_bucket", "value", "group_key"):
        return F.col(name)
    return F.col("group_key") if name == "group" else F.coalesce(F.col("group")[name], F.col("metadata")[name])


def require_fields(obs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows pass as they are; one without one of the comparable keys of its group or metadata fails the query."""
    inner = [n for n in names if n not in ("metric_name", "date", "time_bucket", "value", "group", "group_key")]
    good = F.lit(True)
    for n in inner:
        good = good & field(n).isNotNull()
    return _checked(obs, good, "observation lacks a comparable key: ") if inner else obs


def is_symbol_scoped(group: Column) -> Column:
    return F.exists(F.map_keys(group), lambda k: F.lower(k).isin(*SYMBOL_KEYS))


def symbol_of(group: Column, keys: tuple[str, ...] = SYMBOL_PAGE_KEYS) -> Column:
    """The first of the keys with a value that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(group[k]), F.lit("")) for k in keys])


def flatten(*series: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, series)


def label_periods(reference: DataFrame, target: DataFrame) -> DataFrame:
    """Reference and target in one frame, told apart by period."""
    return reference.withColumn("period", F.lit("benchmark")).unionByName(target.withColumn("period", F.lit("target")))


def first_seen(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Distinct values of a column in the order of their first rows; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("first")).orderBy("first").select(column)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the stored order; each partition keeps only its own first before keys are dealt. Null is a key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def prefix_cut(df: DataFrame, order: list, n: int | None) -> DataFrame:
    """The first n rows in the stored order; all where n is None."""
    return df.orderBy(*order) if n is None else df.orderBy(*order).limit(n)


def collapse_units(obs: DataFrame, keys: tuple[str, ...], how: str = "mean", order: str = "seq") -> DataFrame:
    """One value per key and date; nulls are left out. first and last follow the order column."""
    folds = {"mean": F.avg("value"), "median": F.median("value"), "sum": F.sum("value")}
    if how in ("first", "last"):
        folds[how] = (F.min_by if how == "first" else F.max_by)("value", F.col(order))
    if how not in folds:
        raise ValueError(f"unknown fold: {how}")
    return obs.where("value is not null").groupBy(*keys, "date").agg(folds[how].alias("value"))


def to_stock_metrics(obs: DataFrame, bucket_size: str, metrics: list[str]) -> DataFrame:
    """Wide rows, one column per metric, by the six stored dimensions; of repeated rows the greatest value stays."""
    group = F.col("group")
    others = F.array_sort(F.filter(F.map_entries(group), lambda e: e["key"] != "sym"))
    keys, values = F.array_join(F.transform(others, lambda e: e["key"]), "|"), F.array_join(F.transform(others, lambda e: e["value"]), "|")
    kind = F.when(F.size(others) > 0, keys).when(group["sym"].isNotNull(), "symbol").otherwise("market")
    value = F.when(F.size(others) > 0, values).otherwise(F.coalesce(group["sym"], F.lit("ALL")))
    rows = obs.select(
        "date", F.coalesce("time_bucket", F.lit("FULL_DAY")).alias("timeBucket"), F.lit(bucket_size).alias("bucketSize"),
        F.coalesce(group["sym"], F.lit("ALL")).alias("sym"), kind.alias("groupType"), value.alias("groupValue"), "metric_name", "value")
    return rows.groupBy(*DIMENSIONS).agg(*[F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in metrics])


def from_stock_metrics(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Observations of the wide table. A metric without a column is a miss; several group keys come back as one."""
    present = [m for m in metrics if m in wide.columns]
    rows = wide.unpivot(list(DIMENSIONS), present, "metric_name", "value").where("value is not null")
    named = F.create_map(F.col("groupType"), F.col("groupValue"))
    symbol = F.create_map(F.lit("sym"), F.col("sym"))
    group = (
        F.when((F.col("groupType") == "market") & (F.col("groupValue") == "ALL"), F.create_map().cast("map<string,string>"))
        .when(F.col("groupType") == "symbol", F.create_map(F.lit("sym"), F.col("groupValue")))
        .when(F.col("sym") != "ALL", F.map_concat(named, symbol)).otherwise(named))
    rows = rows.withColumn("group", group)
    return rows.select("metric_name", "date", F.col("timeBucket").alias("time_bucket"), "group", group_key(F.col("group")).alias("group_key"), "value")


def merge_stock_metrics(*wides: DataFrame) -> DataFrame:
    """Wide rows of several tables by their dimensions; a later table's value of a metric overrides an earlier one's."""
    names = list(dict.fromkeys(c for w in wides for c in w.columns if c not in DIMENSIONS))
    parts = []
    for place, wide in enumerate(wides):
        values = [F.struct(F.lit(place).alias("place"), F.col(n).alias("v")) if n in wide.columns else F.lit(None).cast("struct<place:int,v:double>") for n in names]
        parts.append(wide.select(*DIMENSIONS, *[F.when(v["v"].isNotNull(), v).alias(n) for v, n in zip(values, names)]))
    return flatten(*parts).groupBy(*DIMENSIONS).agg(*[F.max(n)["v"].alias(n) for n in names])


def missing_metrics(requested: DataFrame, wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Requested (date, metric_name) pairs that the wide table does not hold."""
    held = from_stock_metrics(wide, metrics).select("date", "metric_name").distinct()
    return requested.join(held, ["date", "metric_name"], "left_anti")


def require_cached(cached: DataFrame, requested: DataFrame) -> DataFrame:
    """Cached rows pass as they are; one of a day or metric that was not requested fails the query when its value is read."""
    asked = requested.select("date", "metric_name").distinct().withColumn("__asked", F.lit(True))
    return _checked(cached.join(asked, ["date", "metric_name"], "left"), F.col("__asked"), "cached row of another day or metric: ").drop("__asked")


def complete(requested: DataFrame, wide: DataFrame, metrics: list[str], computed: DataFrame) -> DataFrame:
    """Observations of all requested (date, metric_name) pairs: from the store where it holds them, else from computed."""
    cached = from_stock_metrics(wide, metrics).join(requested, ["date", "metric_name"], "left_semi")
    fresh = computed.join(missing_metrics(requested, wide, metrics), ["date", "metric_name"], "left_semi")
    return cached.unionByName(fresh.select(*cached.columns))


class StockStore:
    """Wide metric rows stored by day, filled by need.

    held(dates) reads one row per day and metric to the driver: as many as were asked for.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_size: str, metrics: list[str]):
        self.spark, self.path, self.bucket_size, self.metrics = spark, path, bucket_size, metrics

    def _read(self) -> DataFrame | None:
        """The stored table, None before the first write."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def held(self, dates: list[dt.date]) -> set[tuple[dt.date, str]]:
        """The (date, metric) pairs that are stored with at least one value."""
        wide = self._read()
        if wide is None or not dates:
            return set()
        present = [m for m in self.metrics if m in wide.columns]
        counts = wide.where(F.col("date").isin(*dates)).groupBy("date").agg(*[F.count(m).alias(m) for m in present])
        return {(row["date"], m) for row in counts.collect() for m in present if row[m]}

    def write(self, obs: DataFrame) -> None:
        """Stores observations of whole days; days already there keep the metrics that these lack."""
        wide, stored = to_stock_metrics(obs, self.bucket_size, self.metrics), self._read()
        if stored is not None:
            days = wide.select("date").distinct()
            wide = merge_stock_metrics(stored.join(days, "date", "left_semi"), wide)
        write_stock_metrics(wide, self.path)

    def fill(self, dates: list[dt.date], compute: Callable[[list[dt.date], list[str]], DataFrame]) -> list[tuple[list[dt.date], list[str]]]:
        """Computes and stores what of the dates and metrics is not stored; returns the parts that compute was called for.

        compute gets dates as literals, so that it reads only these days of its sources; days that lack the same metrics are
        one part. Rows that it gives for other days or metrics fail.
        """
        held, parts = self.held(dates), {}
        for day in dates:
            lacking = tuple(m for m in self.metrics if (day, m) not in held)
            if lacking:
                parts.setdefault(lacking, []).append(day)
        for names, days in parts.items():
            asked = self.spark.createDataFrame([(d, m) for d in days for m in names], "date date, metric_name string")
            self.write(require_cached(compute(days, list(names)), asked))
        return [(days, list(names)) for names, days in parts.items()]

    def read(self, dates: list[dt.date], metrics: list[str] | None = None) -> DataFrame:
        """Observations of the dates from the store, whose other days are pruned."""
        wide = self._read()
        if wide is None:
            raise ValueError(f"nothing is stored in {self.path}")
        return from_stock_metrics(wide.where(F.col("date").isin(*dates) if dates else F.lit(False)), metrics or self.metrics)


def write_stock_metrics(wide: DataFrame, path: str) -> None:
    """Stores whole days; days already there are replaced."""
    wide.write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def report_arrays(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One compact JSON array of the columns per series, in order; a series is a chart's points."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("__row"))))
    return df.groupBy(*by).agg(F.to_json(F.transform(packed, lambda p: p["__row"])).alias("points"))


def write_report_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

