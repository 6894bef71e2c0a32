"""Trading days, reference windows, universes and the grid of intraday buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import bucket_ms


def trading_days(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct days of the calendar from start to end, both included."""
    if start > end:
        raise ValueError("start must be on or before end")
    return calendar.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("date").distinct()


def weekdays_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Mondays to Fridays from start to end."""
    if start > end:
        raise ValueError("start must be on or before end")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return days.where(F.weekday("date") < 5)


def reference_window(calendar: DataFrame, start: str, lookback: int) -> DataFrame:
    """The last lookback trading days before start, sought from max(3 lookback + 14, lookback + 14) days before it."""
    if lookback < 1:
        raise ValueError("lookback must be positive")
    first = F.date_sub(F.lit(start).cast("date"), max(3 * lookback + 14, lookback + 14))
    days = calendar.where((F.col("date") < F.lit(start).cast("date")) & (F.col("date") >= first)).select("date").distinct()
    return days.orderBy(F.desc("date")).limit(lookback)


def require_days(days: DataFrame, start: str, end: str) -> DataFrame:
    """The days as they are; raises where there is none or one lies outside the period."""
    if days.isEmpty():
        raise ValueError(f"no trading days between {start} and {end}")
    outside = days.where(~F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).limit(1).collect()
    if outside:
        raise ValueError(f"trading day outside the period: {outside[0]['date']}")
    return days


def universe(refs: DataFrame, symbol: str = "sym") -> DataFrame:
    """Distinct symbols that are not blank."""
    return refs.where(F.length(symbol) > 0).select(symbol).distinct()


def filter_universe(refs: DataFrame, symbols: list[str] | None = None, symbol: str | None = None) -> DataFrame:
    """Reference rows of the listed symbols; an empty list keeps all."""
    if symbols and symbol:
        raise ValueError("give symbol or symbols, not both")
    chosen = symbols or ([symbol] if symbol else [])
    return refs.where(F.col("sym").isin(*chosen)) if chosen else refs


def in_universe(ticks: DataFrame, refs: DataFrame) -> DataFrame:
    """Ticks of the symbols and days of the reference data."""
    return ticks.join(refs.select("date", "sym"), ["date", "sym"], "left_semi")


def coerce_date(value: Column) -> Column:
    """Date of a timestamp's, an ISO or a YYYY.MM.DD text; null for anything else."""
    head = F.substring(value.cast("string"), 1, 10)
    return F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "yyyy.MM.dd"))


def bucket_grid(
    spark: SparkSession, sessions: list[tuple[int, int]], bucket: str, auctions: bool = True,
    names: list[str] | None = None, labels: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Buckets of a day in market order; sessions are (start, end) in milliseconds, bucket a text like 5m, 1h or 1d.

    Each session has a row for its opening auction, its continuous buckets (the last may be shorter) and one for its
    closing auction. Sessions without names are AM, PM, S3 and so on, auctions AMO, AMC, PMO, PMC, S3O and so on.
    """
    if not sessions:
        raise ValueError("at least one trading session is required")
    step = bucket_ms(bucket)
    usual = [("AMO", "AMC"), ("PMO", "PMC")]
    rows = []
    for n, (start, end) in enumerate(sessions):
        known = labels or usual
        opening, closing = known[n] if n < len(known) else (f"S{n + 1}O", f"S{n + 1}C")
        name = names[n] if names and n < len(names) and names[n] else ("AM", "PM")[n] if n < 2 else f"S{n + 1}"
        rows.append((n, name, start, end, opening, closing))
    frame = spark.createDataFrame(rows, "i int, session string, start_ms long, end_ms long, opening string, closing string")

    def clock(ms: Column) -> Column:
        return F.format_string("%d:%02d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60)

    begins = frame.where("end_ms > start_ms").select("*", F.explode(F.expr(f"sequence(start_ms, end_ms - 1, {step}L)")).alias("b"))
    stop = F.least(F.col("b") + step, F.col("end_ms"))
    rows = begins.select("i", "session", F.lit(1).alias("phase_no"), F.lit("continuous").alias("phase"), F.col("b").alias("start_ms"),
                         stop.alias("end_ms"), F.concat(clock(F.col("b")), F.lit("-"), clock(stop)).alias("label"))
    if auctions:
        for no, phase, at, label in ((0, "auction_open", "start_ms", "opening"), (2, "auction_close", "end_ms", "closing")):
            rows = rows.unionByName(frame.select(
                "i", "session", F.lit(no).alias("phase_no"), F.lit(phase).alias("phase"), F.col(at).alias("start_ms"), F.col(at).alias("end_ms"),
                F.col(label).alias("label")))
    order = F.row_number().over(Window.orderBy("i", "phase_no", "start_ms"))  # buckets of one day
    return rows.select("label", order.alias("sort_order"), "start_ms", "end_ms", "session", "phase", (F.col("phase") != "continuous").alias("is_auction"))
