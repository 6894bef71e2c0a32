"""Trend series and statistics, overview cards, intraday distribution and profile.

Values that are null, NaN or infinite are no observations; distributions also leave out negative ones. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.functions.scalars import SESSIONS, activity_session, bucket_order, norm_cdf
from tidewatch.operators import ranks
from tidewatch.operators.compare import array_percentile
from tidewatch.operators.definitions import with_definitions
from tidewatch.operators.observations import label_periods

LABELS = {
    "daily": lambda d: F.date_format(d, "yyyy-MM-dd"),
    "weekly": lambda d: F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d)),
    "monthly": lambda d: F.date_format(d, "yyyy-MM"),
    "quarterly": lambda d: F.format_string("%d-Q%d", F.year(d), F.quarter(d)),
    "yearly": lambda d: F.date_format(d, "yyyy"),
}


def _valid(obs: DataFrame) -> DataFrame:
    return obs.where(labels.finite(F.col("value")))


def _fold(volatility: Column) -> Column:
    name = F.col("metric_name")
    return (
        F.when(name == "turnover", F.sum("value")).when(name.isin("quoted_spread_bps", "top_of_book_depth"), F.median("value"))
        .when(name.contains("volatility"), volatility).otherwise(F.avg("value")))


def daily_rollup(obs: DataFrame) -> DataFrame:
    """One value per metric and date: turnover summed, spread and depth by median, others by mean."""
    return _valid(obs).groupBy("metric_name", "date").agg(_fold(F.avg("value")).alias("value"))


def trend_series(obs: DataFrame, grain: str) -> DataFrame:
    """Second rollup over daily values by day, ISO week, month, quarter or year; volatility by root mean square."""
    daily = daily_rollup(obs).withColumn("period", LABELS[grain](F.col("date")))
    return daily.groupBy("metric_name", "period").agg(_fold(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("value"))


def trend_payload(current: DataFrame, reference: DataFrame, grain: str) -> DataFrame:
    """Both periods' series with their flags and each period's mean."""
    series = [trend_series(obs, grain).withColumnRenamed("period", "label") for obs in (reference, current)]
    return label_periods(*series).withColumn("period_mean", F.avg("value").over(Window.partitionBy("metric_name", "period")))


#: Longest untied series whose p-value is exact whatever its order.
EXACT_UP_TO = 33


def rank_statistics(series: DataFrame, by: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    """Per series: n, median size, Theil-Sen slope (null for one value), pairs discordant with time, tied pairs, tie correction and exact p-value.

    A series is one group of days, kept in one task in memory proportional to its length; pairs are counted, not made.
    For Kendall's counts, values that agree to nine digits after the point are ties: adjusted values carry the rounding of their
    sums. The exact p-value is null for tied series, and for series of more than EXACT_UP_TO values with more than one
    pair out of order.
    """

    def statistics(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(["date", "value"])["value"].to_numpy(dtype=float)
        n, slope = len(values), ranks.median_slope(values)
        discordant, tied, correction = ranks.kendall_counts(np.round(values, 9))
        small = n <= EXACT_UP_TO or min(discordant, n * (n - 1) // 2 - discordant) <= 1
        exact = ranks.exact_tail(n, discordant) if small and not tied else None
        return pd.DataFrame([(*key, n, float(np.median(np.abs(values))), slope, discordant, tied, correction, exact)])

    kinds = ", ".join(f"`{c}` {series.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, n long, base double, slope double, discordant long, tied long, correction double, exact double"
    return series.where("value is not null").select(*by, "date", "value").groupBy(*by).applyInPandas(statistics, schema)


def theil_sen(series: DataFrame) -> DataFrame:
    """Median of pairwise slopes per series."""
    return rank_statistics(series).where("slope is not null").select("metric_name", "slope")


def _kendall(stats: DataFrame, exact: bool) -> DataFrame:
    """tau and p_value of rank statistics."""
    n, tied = F.col("n").cast("double"), F.col("tied")
    pairs = n * (n - 1) / 2
    s = pairs - tied - 2 * F.col("discordant")
    tau = s / F.sqrt(F.nullif(pairs * (pairs - tied), F.lit(0.0)))
    variance = (n * (n - 1) * (2 * n + 5) - F.col("correction")) / 18
    p = F.least(F.lit(1.0), 2 * (1 - norm_cdf(F.abs(s) / F.sqrt(F.nullif(variance, F.lit(0.0))))))
    p = F.coalesce("exact", p) if exact else p
    return stats.withColumns({"tau": F.coalesce(tau, F.lit(0.0)), "p_value": F.coalesce(p, F.lit(1.0))})


def kendall(series: DataFrame, exact: bool = True) -> DataFrame:
    """Kendall's tau-b of value against time and its two-sided p-value per series.

    The p-value is exact for untied series that are short or in order but for one pair, else (or without exact) the normal
    approximation with correction for ties.
    """
    return _kendall(rank_statistics(series).where("n > 1"), exact).select("metric_name", "tau", "p_value")


def weekday_adjust(series: DataFrame) -> DataFrame:
    """Value less its weekday's mean plus the overall mean."""
    whole = Window.partitionBy("metric_name")
    day = Window.partitionBy("metric_name", F.weekday("date"))
    return series.select("metric_name", "date", (F.col("value") - F.avg("value").over(day) + F.avg("value").over(whole)).alias("value"))


def rebase(series: DataFrame) -> DataFrame:
    """Series as a percentage of its first value; unchanged where that is 0 or not finite."""
    first = F.first("value").over(Window.partitionBy("metric_name").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    usable = labels.finite(first) & (first != 0)
    return series.select("metric_name", "date", F.when(usable, 100 * F.col("value") / first).otherwise(F.col("value")).alias("value"))


def prepare_trend(series: DataFrame) -> DataFrame:
    """Rebased series; those of ten days or more also adjusted by weekday."""
    based = rebase(series)
    n = F.count("*").over(Window.partitionBy("metric_name"))
    whole, day = Window.partitionBy("metric_name"), Window.partitionBy("metric_name", F.weekday("date"))
    adjusted = F.col("value") - F.avg("value").over(day) + F.avg("value").over(whole)
    return based.select("metric_name", "date", F.when(n >= 10, adjusted).otherwise(F.col("value")).alias("value"))


#: Significance, least slope that counts, and where mild and moderate trends end.
SIGNIFICANCE, FLOOR, MILD, MODERATE = 0.05, 0.004, 0.010, 0.020


def classify_trend(series: DataFrame, exact: bool = True) -> DataFrame:
    """Trend class, tau, p-value, slope, normalised slope and text of each series of daily values."""
    rows = _kendall(rank_statistics(prepare_trend(series)), exact)
    few = F.col("n") < 5
    rows = rows.select(
        "metric_name", "n", *[F.when(few, F.lit(d)).otherwise(F.coalesce(c, F.lit(d))).alias(c) for c, d in (("tau", 0.0), ("p_value", 1.0), ("slope", 0.0))], "base")
    rows = rows.withColumn("normalized_slope", F.coalesce(F.col("slope") / F.nullif(F.col("base"), F.lit(0.0)), F.lit(0.0)))
    size = F.abs("normalized_slope")
    strength = F.when(size < MILD, "mild").when(size < MODERATE, "moderate").otherwise("strong")
    flat = (F.col("p_value") >= SIGNIFICANCE) | (size < FLOOR)
    way = F.when(F.col("slope") > 0, "up").otherwise("down")
    # rounded once: through six digits 0.47950012 would become 0.479 by its tie
    share, slope = (F.replace(F.format_number(F.round(c, ROUNDING), 3), F.lit(","), F.lit("")) for c in (F.col("p_value"), F.col("normalized_slope") * 100))
    numbers = F.concat(F.lit(" (p="), share, F.lit(", normalized slope="), slope, F.lit("% per bucket)."))
    text = (
        F.when(few, "Insufficient observations for robust trend classification.")
        .when(flat, F.concat(F.lit("Target period has no clear directional trend"), numbers))
        .otherwise(F.concat(F.lit("Target period shows a "), strength, F.lit(" "), way, F.lit(" trend"), numbers)))
    label = F.when(few, "insufficient").when(flat, "fluctuating").otherwise(F.concat_ws("_", strength, way, F.lit("trend")))
    return rows.select("metric_name", label.alias("label"), "tau", "p_value", "slope", "normalized_slope", text.alias("summary_text"))


def trend_comments(current: DataFrame, reference: DataFrame, exact: bool = True) -> DataFrame:
    """Trend text of each metric and how its target mean compares with the benchmark's, null without a benchmark."""
    cur, ref = daily_rollup(current), daily_rollup(reference)
    means = cur.groupBy("metric_name").agg(F.avg("value").alias("c")).join(ref.groupBy("metric_name").agg(F.avg("value").alias("r")), "metric_name", "left")
    share = (F.col("c") - F.col("r")) / F.abs(F.nullif(F.col("r"), F.lit(0.0)))
    word = F.when(share >= 0, "above").otherwise("below")
    said = F.when(F.col("r") == 0, "Benchmark mean is zero, so relative mean comparison is not computed.").when(
        F.col("r").isNotNull(), F.concat(F.lit("Target-period mean is "), labels.percent(F.abs(share)), F.lit(" "), word, F.lit(" benchmark mean.")))
    return classify_trend(cur, exact).select("metric_name", F.col("summary_text").alias("trend")).join(means.select("metric_name", said.alias("comparison")), "metric_name")


#: Digits after the point of a relative number that are not the rounding of its sums.
ROUNDING = 12
VOLATILITY_NAMES = ("realized_volatility", "return_volatility", "volatility")
CARDS = (("Traded Value", "turnover"), ("Quoted Spread", "quoted_spread_bps"), ("Top of book Depth", "top_of_book_depth"), ("Volatility", None))


def _period_value(obs: DataFrame) -> DataFrame:
    """Average daily total (turnover), root mean square of all values (volatility) or mean of daily rollups (others)."""
    x = F.col("value")
    daily = _valid(obs).groupBy("metric_name", "date").agg(
        _fold(F.avg("value")).alias("rolled"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.count("*").alias("n"))
    name = F.col("metric_name")
    return daily.groupBy("metric_name").agg(
        F.when(name == "turnover", F.avg("total")).when(name.contains("volatility"), F.sqrt(F.sum("squares") / F.sum("n"))).otherwise(F.avg("rolled")).alias("value"))


def overview_cards(current: DataFrame, reference: DataFrame) -> DataFrame:
    """The four cards: value, relative change against the reference period and their texts.

    A change below the rounding of sums is none.
    """
    cur, ref = _period_value(current), _period_value(reference).select("metric_name", F.col("value").alias("reference"))
    rows = with_definitions(cur.join(ref, "metric_name", "left"), "unit")
    preferred = F.array_position(F.array(*[F.lit(v) for v in VOLATILITY_NAMES]), F.col("metric_name"))
    chosen = F.row_number().over(Window.partitionBy(F.col("metric_name").contains("volatility")).orderBy(F.col("metric_name").isin(*VOLATILITY_NAMES).cast("int").desc(), preferred, "metric_name"))
    card = F.when(F.col("metric_name").contains("volatility") & (chosen == 1), len(CARDS))
    for place, (_, name) in enumerate(CARDS, 1):
        if name:
            card = F.when(F.col("metric_name") == name, place).otherwise(card)
    change = F.round((F.col("value") - F.col("reference")) / F.nullif(F.col("reference"), F.lit(0.0)), ROUNDING)
    rows = rows.withColumn("place", card).where("place is not null").withColumn("change_pct", change)
    title = F.element_at(F.array(*[F.lit(t) for t, _ in CARDS]), F.col("place"))
    return rows.select("place", title.alias("card"), "metric_name", "value", "change_pct", labels.card_text(F.col("value"), F.coalesce("unit", F.lit(""))).alias("value_text"),
                       labels.delta_text(F.col("change_pct")).alias("delta_text"), labels.delta_direction(F.col("change_pct")).alias("direction"))


BARS = 30


def minmax_scale(value: Column, *by: str) -> Column:
    """28 to 96 between the least and greatest value of a series, 55 in one that is flat but for the rounding of its sums."""
    over = Window.partitionBy(*by)
    low, high = F.min("value").over(over), F.max("value").over(over)
    return F.when(high - low > 10.0**-ROUNDING * F.greatest(F.abs(low), F.abs(high)), 28 + 68 * (value - low) / (high - low)).otherwise(55.0)


def spark_bars(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Daily means per metric, binned by week, month or quarter where there are more than BARS, with bar and mean heights."""
    daily = _valid(current).groupBy("metric_name", "date").agg(F.avg("value").alias("value"))
    grains = F.array(*[F.struct(F.lit(i).alias("grain"), LABELS[g](F.col("date")).alias("label")) for i, g in enumerate(("daily", "weekly", "monthly", "quarterly"))])
    binned = daily.select("metric_name", "value", F.inline(grains)).groupBy("metric_name", "grain", "label").agg(F.avg("value").alias("value"))
    sized = binned.withColumn("n", F.count("*").over(Window.partitionBy("metric_name", "grain")))
    sized = sized.withColumn("usable", F.when((F.col("n") <= BARS) | (F.col("grain") == 3), F.col("grain")))
    bars = sized.withColumn("best", F.min("usable").over(Window.partitionBy("metric_name"))).where("grain = best")
    mean = _valid(reference).groupBy("metric_name").agg(F.avg("value").alias("benchmark_mean"))
    bars = bars.join(F.broadcast(mean), "metric_name", "left")  # one row per metric
    line = minmax_scale(F.col("benchmark_mean"), "metric_name")
    return bars.select("metric_name", "label", "value", minmax_scale(F.col("value"), "metric_name").alias("height"),
                       F.when(F.col("benchmark_mean").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), line))).alias("mean_height"))


def _day_sums(obs: DataFrame, *by: Column) -> DataFrame:
    """Activity per date and bucket (and further columns), without negative values."""
    return _valid(obs).where("value >= 0").groupBy(*by, "date", F.coalesce("time_bucket", F.lit("Full day")).alias("time_bucket")).agg(F.sum("value").alias("value"))


def cumulative_share(df: DataFrame, *by: str) -> DataFrame:
    """Running share of value over buckets in market order, as share; 0 where a series has no activity."""
    order = Window.partitionBy(*by).orderBy(bucket_order(F.col("time_bucket")), "time_bucket")
    total = F.sum("value").over(Window.partitionBy(*by))
    running = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("share", F.when(total > 0, 100 * running / total).otherwise(0.0))


def activity_distribution(current: DataFrame, reference: DataFrame) -> DataFrame:
    """The distribution of two tables of observations; see activity_distribution_periods."""
    both = _day_sums(current).withColumn("now", F.lit(True)).unionByName(_day_sums(reference).withColumn("now", F.lit(False)))
    return _distribution(both)


def activity_distribution_periods(obs: DataFrame, current: Column, reference: Column) -> DataFrame:
    """Per bucket in market order: the current cumulative share and the spread of the reference days' shares.

    The current share is of the mean over dates; a bucket that a period or day lacks adds nothing to it. Observations are
    read once. The sums of days and buckets of both periods, a few thousand numbers, end in one row, from which all shares are read.
    """
    return _distribution(_day_sums(obs.where(current | reference), F.coalesce(current, F.lit(False)).alias("now")))


def _running_shares(values: Column) -> Column:
    """Running percentage of an array's total; 0 everywhere without activity."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    sums = F.aggregate(values, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out")))["out"]
    return F.transform(sums, lambda x: F.when(total > 0, 100 * x / total).otherwise(0.0))


def _distribution(sums: DataFrame) -> DataFrame:
    name = F.struct(bucket_order(F.col("time_bucket")).alias("bucket_order"), "time_bucket")
    days = sums.groupBy("now", "date").agg(
        F.map_from_entries(F.collect_list(F.struct("time_bucket", "value"))).alias("held"), F.collect_list(name).alias("names"))
    one = days.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.collect_list(F.when(F.col("now"), F.col("held"))).alias("mine"),
        F.collect_list(F.when(~F.col("now"), F.col("held"))).alias("theirs"))

    def mean(bucket: Column) -> Column:
        known = F.array_compact(F.transform("mine", lambda day: day[bucket]))
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0)

    one = one.withColumn("current", _running_shares(F.transform("names", lambda n: mean(n["time_bucket"]))))
    one = one.withColumn("days", F.transform("theirs", lambda day: _running_shares(F.transform("names", lambda n: F.coalesce(day[n["time_bucket"]], F.lit(0.0))))))
    places = F.transform("names", lambda n, i: F.struct(
        n["time_bucket"].alias("time_bucket"), n["bucket_order"].alias("bucket_order"), F.get("current", i).alias("current"),
        F.array_sort(F.transform("days", lambda day: F.get(day, i))).alias("shares")))
    shares = F.col("shares")
    return one.select(F.inline(places)).select(
        "time_bucket", "bucket_order", "current", array_percentile(shares, 0.25).alias("q1"), array_percentile(shares, 0.5).alias("median"),
        array_percentile(shares, 0.75).alias("q3"), F.array_min(shares).alias("low"), F.array_max(shares).alias("high"))


def _box(column: str) -> list[Column]:
    return [F.percentile(column, F.lit(0.25)).alias("q1"), F.median(column).alias("median"), F.percentile(column, F.lit(0.75)).alias("q3"),
            F.min(column).alias("low"), F.max(column).alias("high")]


def session_share(obs: DataFrame) -> DataFrame:
    """Mean over dates of the share of each of the seven sessions; absent sessions are 0."""
    sums = _valid(obs).where("value >= 0").groupBy("date", activity_session(F.col("time_bucket")).alias("session")).agg(F.sum("value").alias("value"))
    total = F.sum("value").over(Window.partitionBy("date"))
    shares = sums.withColumn("share", F.when(total > 0, 100 * F.col("value") / total).otherwise(0.0))
    days = sums.agg(F.count_distinct("date").alias("days"))
    means = shares.groupBy("session").agg(F.sum("share").alias("total")).join(F.broadcast(days)).select("session", (F.col("total") / F.col("days")).alias("share"))
    every = obs.sparkSession.createDataFrame([(s,) for s in SESSIONS], "session string")
    return F.broadcast(every).join(means, "session", "left").fillna(0.0, ["share"])


def intraday_profile(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Per metric and bucket: the current mean and the spread of the reference days' means."""
    bucket = F.coalesce("time_bucket", F.lit("Full day")).alias("time_bucket")
    cur = _valid(current).groupBy("metric_name", bucket).agg(F.avg("value").alias("current"))
    means = _valid(reference).groupBy("metric_name", "date", bucket).agg(F.avg("value").alias("value"))
    both = cur.join(means.groupBy("metric_name", "time_bucket").agg(*_box("value")), ["metric_name", "time_bucket"], "full")
    return both.withColumn("bucket_order", bucket_order(F.col("time_bucket")))


def chart_points(obs: DataFrame, n: int | None = None) -> DataFrame:
    """Points of a metric's chart, the first n of each in the order of date, bucket and group, with display labels."""
    place = F.row_number().over(Window.partitionBy("metric_name").orderBy("date", bucket_order(F.col("time_bucket")), "time_bucket", "group_key", "value"))
    rows = obs.withColumn("place", place)
    rows = rows if n is None else rows.where(F.col("place") <= n)
    return rows.select("metric_name", "place", "date", labels.bucket_label(F.col("time_bucket")).alias("bucket"), labels.group_label(F.col("group")).alias("label"), "value")


CHART_MODES = ("time_series", "intraday", "reference_target")


def chart_table(obs: DataFrame, mode: str = "time_series", n: int | None = None, reference: DataFrame | None = None) -> DataFrame:
    """Points of each metric's chart as texts, the first n of each.

    The x text is date and bucket (time_series), the bucket, or the date without one (intraday), or the date
    (reference_target). The last sets reference observations before obs, names the period in the metadata and the bucket in the series.
    """
    if mode not in CHART_MODES:
        raise ValueError(f"mode must be one of: {', '.join(CHART_MODES)}")
    rows = obs.withColumn("period", F.lit("target"))
    if mode == "reference_target" and reference is not None:
        rows = reference.withColumn("period", F.lit("reference")).unionByName(rows)
    place = F.row_number().over(Window.partitionBy("metric_name").orderBy("period", "date", bucket_order(F.col("time_bucket")), "time_bucket", "group_key", "value"))
    rows = with_definitions(rows, "unit").withColumn("place", place)
    rows = rows if n is None else rows.where(F.col("place") <= n)
    bucket, day, series = labels.bucket_label(F.col("time_bucket")), F.col("date").cast("string"), labels.group_label(F.col("group"))
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    if mode == "reference_target":
        series = F.nullif(F.concat_ws(", ", series, F.concat(F.lit("Intraday bucket: "), bucket)), F.lit(""))
        metadata = F.map_concat(F.create_map(F.lit("period"), F.col("period")), F.map_filter(metadata, lambda k, _: k != "period"))
    x = {"time_series": F.concat_ws(" ", day, bucket), "intraday": F.coalesce(bucket, day), "reference_target": day}[mode]
    return rows.select("metric_name", "place", x.alias("x_text"), bucket.alias("bucket_text"), series.alias("series_text"),
                       labels.value_text(F.col("value"), F.coalesce("unit", F.lit(""))).alias("value_text"), labels.group_label(metadata).alias("metadata_text"), "value")


def heatmap_cells(obs: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Cells bucket x group value of a metric with value texts, the first n of each."""
    rows = with_definitions(obs.where(F.col("group")[key].isNotNull()), "unit")
    place = F.row_number().over(Window.partitionBy("metric_name").orderBy("date", bucket_order(F.col("time_bucket")), "time_bucket", "group_key", "value"))
    rows = rows.withColumn("place", place)
    rows = rows if n is None else rows.where(F.col("place") <= n)
    return rows.select("metric_name", "place", labels.bucket_label(F.col("time_bucket")).alias("x"), F.col("group")[key].alias("y"), "value",
                       labels.value_text(F.col("value"), F.coalesce("unit", F.lit(""))).alias("value_text"))


def period_text(obs: DataFrame) -> DataFrame:
    """First and last date and number of dates, as text."""
    span = obs.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b"), F.count_distinct("date").alias("n"))
    return span.select(F.when(F.col("n") == 0, "n/a").when(F.col("n") == 1, F.concat("a", F.lit(" (1 day)"))).otherwise(
        F.concat("a", F.lit(" to "), "b", F.lit(" ("), F.col("n").cast("string"), F.lit(" days)"))).alias("period_text"))
