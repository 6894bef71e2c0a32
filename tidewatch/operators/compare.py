"""Comparison of current observations with the reference distribution of the same key.

Reference values are folded to one per key and day, and the days of a key are gathered as one sorted array, which is as
long as the reference window: callers bound it by calendar.reference_window (30 days or more, as a z-score needs 30). Every statistic
and share is read from that array, so that a comparison is one pass over both periods.

A key without reference days has sample size 0 and no statistics; null matches null in every key. Null values are no
observations of the reference; a current row with a null value stays, without scores. Repeated current rows stay.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import finite, settled
from tidewatch.functions.scalars import norm_cdf
from tidewatch.operators.definitions import with_definitions
from tidewatch.operators.observations import field, require_fields, require_reversion

KEYS = ("metric_name", "time_bucket", "group_key")
REVERSION_KEYS = ("metric_name", "time_bucket", "venue", "horizon", "group_key")
MIN_NORMAL, MIN_WEAK, MIN_RANGE, MAD_SCALE = 30, 10, 2, 1.4826
#: Order of severity.
PRIORITY = {"alert": 0, "watch": 1, "comparison_only": 2, "normal": 3}


def array_percentile(values: Column, p: float) -> Column:
    """Percentile of a sorted array, interpolated between neighbours; null for an empty one."""
    rank = (F.size(values) - 1) * F.lit(p)
    low, high = F.get(values, F.floor(rank).cast("int")), F.get(values, F.ceil(rank).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (rank - F.floor(rank)))


def array_stats(rows: DataFrame) -> DataFrame:
    """Mean, median, deviation, least, greatest, 5th and 95th percentile and MAD of each row's sorted array of days.

    Statistics of an array do not depend on how rows were dealt. The mean of equal days is their value, without the rounding of
    their sum, so that their deviation is 0.
    """
    days, n = F.col("days"), F.size("days")
    mean = F.when(F.get(days, F.lit(0)) == F.get(days, n - 1), F.get(days, F.lit(0))).when(n > 0, F.aggregate(days, F.lit(0.0), lambda s, x: s + x) / n)
    rows = rows.withColumns({"mean": mean, "low": F.get(days, F.lit(0)), "high": F.when(n > 0, F.get(days, n - 1)), "median": array_percentile(days, 0.5),
                             "p5": array_percentile(days, 0.05), "p95": array_percentile(days, 0.95)})
    squares = F.aggregate(days, F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    rows = rows.withColumns({"std": F.when(n > 1, F.sqrt(squares / (n - 1))), "distances": F.array_sort(F.transform(days, lambda x: F.abs(x - F.col("median"))))})
    return rows.withColumn("mad", array_percentile(F.col("distances"), 0.5))


def reference_stats(units: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, mean, median, deviation, least, greatest, 5th and 95th percentile, MAD and the sorted days of each key."""
    rows = units.groupBy(*keys).agg(F.count("value").alias("n"), F.array_sort(F.collect_list("value")).alias("days"))  # as many as the window has days
    return array_stats(rows)


def _share(values: Column, test) -> Column:
    return F.size(F.filter(values, test)) / F.size(values)


def _folded(value: Column, fold: str, order: str, over: Window) -> Column:
    """Values of a window folded to one."""
    folds = {"mean": F.avg(value), "median": F.median(value), "sum": F.sum(value)}
    if fold in ("first", "last"):
        folds[fold] = (F.min_by if fold == "first" else F.max_by)(value, F.when(value.isNotNull(), F.col(order)))
    if fold not in folds:
        raise ValueError(f"unknown fold: {fold}")
    return folds[fold].over(over)


def _computed(rows: DataFrame, given: list[str]) -> DataFrame:
    """rows with all but the given columns computed here, once.

    The optimizer pushes filters on a column into what it is computed from, by copies of its expression; a status would be copied
    with all scores and statistics below it. It does not push them through a generator.
    """
    made = [c for c in rows.columns if c not in given]
    return rows.select(*[c for c in rows.columns if c in given], F.inline(F.array(F.struct(*made))))


def compare(current: DataFrame, reference: DataFrame, keys: tuple[str, ...] = KEYS, robust: bool = True, fold: str = "mean",
            higher_is_better: Column | None = None) -> DataFrame:
    """One row per current observation, compared with reference observations of another table."""
    both = current.withColumn("__current", F.lit(True)).unionByName(reference.withColumn("__current", F.lit(False)), allowMissingColumns=True)
    mine = compare_periods(both, F.col("__current"), ~F.col("__current"), keys, robust, fold, higher_is_better).drop("__current")
    return mine.drop(*[c for c in reference.columns if c not in current.columns and c not in keys])


def compare_periods(obs: DataFrame, current: Column, reference: Column, keys: tuple[str, ...] = KEYS, robust: bool = True, fold: str = "mean",
                    higher_is_better: Column | None = None, order: str = "seq") -> DataFrame:
    """One row per current observation with reference value, change, scores, tails, confidence and status.

    Current and reference rows are told apart by conditions on one table, which is computed once and dealt once, by key:
    the reference days are folded and gathered by windows within that exchange. The direction of a metric is its
    definition's, unless higher_is_better gives one: True, False or null (neither).
    """
    keyed = require_fields(obs.where(current | reference), keys).select(
        "*", *[field(k).alias(k) for k in keys if k not in obs.columns], current.alias("__now"), F.when(reference, F.col("value")).alias("__was"))
    dealt = keyed.repartition(*keys)
    unit = Window.partitionBy(*keys, "date")
    lead = F.row_number().over(unit.orderBy(F.col("__was").isNull()))
    days = dealt.withColumn("__lead", lead).withColumn("__unit", F.when((F.col("__lead") == 1) & F.col("__was").isNotNull(), _folded(F.col("__was"), fold, order, unit)))
    days = days.withColumn("days", F.array_sort(F.collect_list("__unit").over(Window.partitionBy(*keys)))).where("__now")
    rows = array_stats(days.withColumn("n", F.size("days")))
    rows = with_definitions(rows, "higher_is_better") if higher_is_better is None else rows.withColumn("higher_is_better", higher_is_better)
    v, n, days, better = F.col("value"), F.coalesce("n", F.lit(0)), F.col("days"), F.col("higher_is_better")
    centre, width = ("median", MAD_SCALE * F.col("mad")) if robust else ("mean", F.col("std"))
    z = F.when((n >= MIN_NORMAL) & (width != 0), (v - F.col(centre)) / width)
    enough = (n >= MIN_WEAK) & v.isNotNull()
    tail = (
        F.when(better, _share(days, lambda x: x <= v)).when(~better, _share(days, lambda x: x >= v))
        .otherwise(_share(F.col("distances"), lambda d: d >= F.abs(v - F.col("median")))))
    rows = rows.select(
        *[c for c in obs.columns if c != "metadata"], *[k for k in keys if k not in obs.columns], n.cast("long").alias("reference_sample_size"),
        F.col(centre).alias("reference_value"), z.alias("z_score"), F.when(enough, _share(days, lambda x: x <= v)).alias("empirical_percentile"),
        F.when(enough, tail).alias("empirical_adverse_tail"), better, "p5", "p95",
        F.when(n >= MIN_RANGE, 100 * (v - F.col("p5")) / F.nullif(F.col("p95") - F.col("p5"), F.lit(0.0))).alias("range_position_score"))
    cdf = norm_cdf(F.col("z_score"))
    normal_tail = F.when(better, cdf).when(~better, 1 - cdf).otherwise(2 * F.least(cdf, 1 - cdf))
    change = v - F.col("reference_value")
    rows = rows.withColumns({
        "percentile": F.col("empirical_percentile"), "normal_percentile": cdf, "normal_adverse_tail": F.when(F.col("z_score").isNotNull(), normal_tail), "change_abs": change,
        "change_pct": change / F.nullif(F.col("reference_value"), F.lit(0.0)), "comparison_method": F.lit("robust" if robust else "standard"),
        "comparison_confidence": confidence(F.col("reference_sample_size")), "message": sample_message(F.col("reference_sample_size"))})
    return _computed(rows.withColumn("status", status()), obs.columns)


def confidence(n: Column) -> Column:
    return F.when(n < MIN_WEAK, "insufficient").when(n < MIN_NORMAL, "weak").otherwise("normal")


def sample_message(n: Column) -> Column:
    """What a small sample means; null for one that is large enough."""
    few = F.concat(F.lit("low-confidence comparison: "), n.cast("string"), F.lit(f" reference observations; {MIN_NORMAL} required for headline z-score"))
    return F.when(n == 1, "comparison only: one reference observation, so z-score is undefined").when(n < MIN_NORMAL, few)


def status() -> Column:
    """Status of a scored row by its tail; a normal-score tail of null or 0 gives way to the empirical one."""
    tail = F.coalesce(F.nullif(F.col("normal_adverse_tail"), F.lit(0.0)), F.col("empirical_adverse_tail"))
    size = F.abs("z_score")
    return (
        F.when((F.col("comparison_confidence") == "insufficient") & F.col("z_score").isNull(), "comparison_only")
        .when(tail <= 0.025, "alert").when(tail <= 0.10, "watch").when(tail.isNotNull(), "normal")
        .when(size >= 2.0, "alert").when(size >= 1.5, "watch").otherwise("normal"))


def compare_reversion(current: DataFrame, reference: DataFrame, robust: bool = True, fold: str = "mean") -> DataFrame:
    """Comparison of reversion observations by venue and horizon; lower is better whatever the definition says."""
    return compare(require_reversion(current), require_reversion(reference), REVERSION_KEYS, robust, fold, F.lit(False))


def compare_reversion_periods(obs: DataFrame, current: Column, reference: Column, robust: bool = True, fold: str = "mean") -> DataFrame:
    """The same of one table of reversion observations."""
    return compare_periods(require_reversion(obs), current, reference, REVERSION_KEYS, robust, fold, F.lit(False))


def priority(column: str = "status") -> Column:
    out = F.lit(99)
    for name, rank in PRIORITY.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def size_of(column: str) -> Column:
    """Size of a number to six digits, 0 where it is null or not finite."""
    return F.when(finite(F.col(column)), F.abs(settled(F.col(column)))).otherwise(0.0)


def report_order(label: str = "label") -> list[Column]:
    """Order of report rows: status, size of z, the metric's label, date, bucket and group; then name and value, for a total order."""
    return [priority(), F.desc(size_of("z_score")), F.col(label), F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("time_bucket", F.lit("")),
            F.col("group_key"), F.col("metric_name"), F.asc_nulls_first("value")]


def severity() -> list[Column]:
    """Order for choosing rows across metrics: status, sizes of z and of the relative change, then names; total."""
    return [priority(), F.desc(size_of("z_score")), F.desc(size_of("change_pct")), F.col("metric_name"), F.asc_nulls_first("date"),
            F.asc_nulls_first("time_bucket"), F.col("group_key"), F.asc_nulls_first("value")]


def liquidity_stress(cmp: DataFrame) -> DataFrame:
    """z of the spread plus z of volatility less z of depth, per bucket, group and date; null where one is missing."""

    def z(metric: str):
        return F.max(F.when(F.col("metric_name") == metric, F.col("z_score")))

    stress = z("quoted_spread_bps") + z("parkinson_volatility_bps") - z("top_of_book_depth")
    return cmp.groupBy("time_bucket", "group_key", "date").agg(stress.alias("stress"))


def group_deltas(current: DataFrame, reference: DataFrame, n: int = 12) -> DataFrame:
    """Current mean per group against the reference mean of daily means, by size of the difference."""
    cur = current.groupBy("metric_name", "group_key").agg(F.avg("value").alias("current"))
    daily = reference.groupBy("metric_name", "group_key", "date").agg(F.avg("value").alias("value"))
    ref = daily.groupBy("metric_name", "group_key").agg(F.avg("value").alias("reference"))
    rows = cur.join(ref, ["metric_name", "group_key"]).withColumn("delta", F.col("current") - F.col("reference"))
    return rows.orderBy(F.desc(F.abs("delta")), "metric_name", "group_key").limit(n)
