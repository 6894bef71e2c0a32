"""The metric definition table and look-ups of direction, unit and default aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, label, unit, whether higher is better (None: neither), default aggregation, interpretation.
METRICS = [
    ("turnover", "Turnover", "JPY", None, "sum", "Higher turnover indicates more trading activity."),
    ("volume", "Volume", "shares", None, "sum", "Higher volume indicates more share trading activity."),
    ("trade_count", "Trade Count", "count", None, "sum", "Higher trade count indicates more frequent trading."),
    ("quoted_spread_bps", "Quoted Spread", "bps", False, "median",
     "Higher values usually indicate worse liquidity and higher immediate transaction cost."),
    ("top_of_book_depth", "Top-of-Book Depth", "lots", True, "median", "Higher values usually indicate more immediately available liquidity."),
    ("parkinson_volatility_bps", "Parkinson Vola", "bps", False, "mean",
     "Higher values indicate wider intrabucket price ranges and potentially higher short-horizon market-state volatility."),
]
HORIZONS = ("10ms", "100ms", "500ms", "1s", "5s", "10s")
REVERSION_PREFIX, REVERSION_SUFFIX = "primary_quote_reversion_", "_bps"
_REVERSION_TEXT = (
    "Positive values mean the primary mid moved in the aggressive trade direction, suggesting greater adverse selection or toxicity. "
    "Negative values mean the initial trade direction reverted at the selected horizon.")
#: Metric families of the overview, in order.
FAMILIES = {
    "Market activity": ("turnover", "volume", "trade_count"), "Displayed liquidity": ("quoted_spread_bps", "top_of_book_depth"),
    "Cross-venue reversion": tuple(f"{REVERSION_PREFIX}{h}{REVERSION_SUFFIX}" for h in HORIZONS)}


def metric_definitions(spark: SparkSession) -> DataFrame:
    """One row per metric; twelve rows, so that joins can broadcast it."""
    rows = METRICS + [
        (f"{REVERSION_PREFIX}{h}{REVERSION_SUFFIX}", f"+{h} Reversion", "bps", False, "notional_weighted_mean", _REVERSION_TEXT) for h in HORIZONS]
    return spark.createDataFrame(
        rows, "metric_name string, label string, unit string, higher_is_better boolean, default_aggregation string, interpretation string")


def with_definitions(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns of its metric's definition, null where there is none."""
    return df.join(F.broadcast(metric_definitions(df.sparkSession).select("metric_name", *columns)), "metric_name", "left")


def undefined_metrics(df: DataFrame) -> DataFrame:
    """Distinct metric names without a definition."""
    return df.select("metric_name").distinct().join(F.broadcast(metric_definitions(df.sparkSession).select("metric_name")), "metric_name", "left_anti")


def is_reversion(metric: Column) -> Column:
    return metric.startswith(REVERSION_PREFIX) & metric.endswith(REVERSION_SUFFIX)


def horizon_of(metric: Column) -> Column:
    """Horizon in a reversion metric's name; null for other metrics."""
    return F.when(is_reversion(metric), F.regexp_extract(metric, f"^{REVERSION_PREFIX}(.*){REVERSION_SUFFIX}$", 1))


def family_of(metric: Column) -> Column:
    """Family of a metric; one in no family is its own."""
    out = metric
    for family, names in FAMILIES.items():
        out = F.when(metric.isin(*names), family).otherwise(out)
    return out
