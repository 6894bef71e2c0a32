"""Metric facts per date, bucket, symbol and capitalisation group, their rollups and the long observations.

Ticks without symbol, or whose price, size or spread is null or not positive, are in no fact; a null size counts for neither depth
nor volume. Repeated ticks count as often as they occur. Symbols without a reference row stay in activity and volatility with a
null group, and have no liquidity, which needs the lot size. Empty tables give empty facts. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import time_bucket, time_bucket_continuous
from tidewatch.operators.observations import to_observations
from tidewatch.sources.ticks import require_columns

KEYS = ("date", "time_bucket", "sym", "topixCapGrp")


def enrich(facts: DataFrame, refs: DataFrame, *columns: str) -> DataFrame:
    """Left join of the day's reference row, one per date and symbol; facts without one stay, with nulls.

    Facts are joined after they are aggregated, so that no tick is shuffled for it. A plain equi-join on purpose:
    reference data grows with days and symbols, so the choice of a broadcast is left to the size statistics.
    """
    return facts.join(refs.select("date", "sym", "topixCapGrp", *columns), ["date", "sym"], "left")


def exact_sum(value: Column) -> Column:
    """Sum of money or sizes to six digits, the same in whatever order it is added; what is no finite number adds nothing."""
    return F.sum(value.try_cast("decimal(38,6)")).cast("double")


def activity(trades: DataFrame, refs: DataFrame, bucket_ms: int) -> DataFrame:
    require_columns(trades, "date", "time_ms", "sym", "session", "auction", "tradePrice", "tradeSize", role="trades")
    valid = trades.where("tradePrice > 0 and tradeSize > 0 and sym is not null")
    label = time_bucket(F.col("time_ms"), F.col("session"), F.col("auction"), bucket_ms).alias("time_bucket")
    sums = valid.groupBy("date", label, "sym").agg(
        exact_sum(F.col("tradePrice") * F.col("tradeSize")).alias("turnover"), exact_sum(F.col("tradeSize")).alias("volume"), F.count("*").alias("trade_count"))
    return enrich(sums, refs).select(*KEYS, "turnover", "volume", "trade_count")


def _quotes(quotes: DataFrame) -> DataFrame:
    require_columns(quotes, "date", "time_ms", "sym", "bidPrice", "askPrice", "bidSize", "askSize", role="quotes")
    spread = 10000 * (F.col("askPrice") - F.col("bidPrice")) / ((F.col("askPrice") + F.col("bidPrice")) / 2)
    valid = quotes.where("bidPrice > 0 and askPrice > bidPrice and sym is not null")
    return valid.withColumn("spread", spread).withColumn("size", F.col("bidSize") + F.col("askSize"))


def liquidity(quotes: DataFrame, refs: DataFrame, bucket_ms: int, accuracy: int | None = None) -> DataFrame:
    """Median spread and depth in lots; a quote without lot size is left out. accuracy asks for approximate medians."""
    middle = F.median if accuracy is None else lambda c: F.percentile_approx(c, 0.5, accuracy)
    label = time_bucket_continuous(F.col("time_ms"), bucket_ms).alias("time_bucket")
    facts = _quotes(quotes).groupBy("date", label, "sym").agg(middle("spread").alias("quoted_spread_bps"), middle("size").alias("size"))
    # the lot size is one per date and symbol, so that the median can be divided by it
    return enrich(facts, refs, "lotSize").where("lotSize > 0").select(*KEYS, "quoted_spread_bps", (F.col("size") / F.col("lotSize")).alias("top_of_book_depth"))


def parkinson(trades: DataFrame, refs: DataFrame, bucket_ms: int) -> DataFrame:
    """Range volatility; auction prints count in their clock bucket."""
    require_columns(trades, "date", "time_ms", "sym", "tradePrice", role="trades")
    label = time_bucket_continuous(F.col("time_ms"), bucket_ms).alias("time_bucket")
    ranged = trades.where("tradePrice > 0 and sym is not null").groupBy("date", label, "sym").agg(F.max("tradePrice").alias("high"), F.min("tradePrice").alias("low"))
    spread = F.pow(F.log(F.col("high") / F.col("low")), 2)
    return enrich(ranged, refs).select(*KEYS, (10000 * F.sqrt(spread / (4 * F.log(F.lit(2.0))))).alias("parkinson_volatility_bps"))


def pre_aggregate(facts: DataFrame) -> DataFrame:
    return facts.groupBy("date", "time_bucket", "topixCapGrp").agg(
        *[F.sum(c).alias(c) for c in ("turnover", "volume", "trade_count")])


#: level: (group type, group value, columns that it keeps)
LEVELS = {
    "market": ("market", F.lit, ("date",)), "market_bucket": ("market", F.lit, ("date", "time_bucket")),
    "topix_cap_group": ("topixCapGrp", F.col, ("date", "topixCapGrp")),
    "topix_cap_group_bucket": ("topixCapGrp", F.col, ("date", "time_bucket", "topixCapGrp")),
    "symbol": ("sym", F.col, ("date", "sym")), "symbol_bucket": ("sym", F.col, ("date", "time_bucket", "sym")),
}
MARKET = "TSE"


def _scope(level: str) -> list[Column]:
    kind = LEVELS[level][0]
    value = F.lit(MARKET) if kind == "market" else F.col(kind)
    return [F.lit(level).alias("aggregationLevel"), F.lit(kind).alias("groupType"), value.alias("groupValue")]


def _usable(facts: DataFrame, levels: list[str]) -> list[str]:
    return [n for n in levels if n in LEVELS and all(c in facts.columns for c in LEVELS[n][2])]


def label_levels(facts: DataFrame, levels: list[str]) -> DataFrame:
    """Every fact once per level with the level's labels, in one pass; levels that lack a column are skipped."""
    scopes = [F.struct(*_scope(n)) for n in _usable(facts, levels)]
    if not scopes:
        return facts.limit(0)
    return facts.select("*", F.inline(F.array(*scopes)))


def _labelled(facts: DataFrame, levels: list[str]) -> list[Column]:
    found = []
    for n in _usable(facts, levels):
        bucket = F.col("time_bucket") if "time_bucket" in LEVELS[n][2] else F.lit(None).cast("string")
        found.append(F.struct(*_scope(n), bucket.alias("bucket")))
    return found


_LEVEL_KEYS = ("date", "time_bucket", "aggregationLevel", "groupType", "groupValue")


def _by_level(facts: DataFrame, levels: list[str], *columns: str) -> DataFrame:
    """Every fact once per level, with the level's labels in place of what the level leaves out."""
    rows = facts.select("date", *columns, F.inline(F.array(*_labelled(facts, levels))))
    return rows.withColumnRenamed("bucket", "time_bucket")


def rollup_levels(facts: DataFrame, levels: list[str], sums: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of additive facts per level (and further keys): one partial aggregation over the labelled facts."""
    return _by_level(facts, levels, *by, *sums).groupBy(*_LEVEL_KEYS, *by).agg(*[F.sum(c).alias(c) for c in sums])


def value_bin(value: Column) -> Column:
    """Coarse bin of a number, increasing with it: about 1.6 % wide, so that a few hundred hold a decade; one bin for what is not finite."""
    size = F.floor(F.log(F.abs(value)) * 64) + 47_700
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(~finite, 1 << 20).when(value == 0, 0).when(value > 0, size).otherwise(-size).cast("long")


def histogram_median(counts: DataFrame, by: list[str]) -> DataFrame:
    """Exact median of every group of `by`, from rows (by, value, n).

    Two levels: running counts over coarse bins find the bin, or two, of the middle ranks; running counts over the values of only
    these bins find the middle values. A task holds the bins of a group or the distinct values of one bin, never a whole group.
    """
    binned = counts.withColumn("bin", value_bin(F.col("value")))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = binned.groupBy(*by, "bin").agg(F.sum("n").alias("in_bin"))
    bins = bins.withColumn("before", F.sum("in_bin").over(upto) - F.col("in_bin")).withColumn("total", F.sum("in_bin").over(whole))
    bins = bins.withColumn("low", F.floor((F.col("total") - 1) / 2)).withColumn("high", F.floor(F.col("total") / 2))  # middle ranks from 0
    chosen = bins.where((F.col("before") <= F.col("high")) & (F.col("before") + F.col("in_bin") > F.col("low")))
    same = F.lit(True)
    for c in (*by, "bin"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    near = binned.join(chosen.select(*[F.col(c).alias(f"__{c}") for c in (*by, "bin")], "before", "low", "high"), same)
    inside = Window.partitionBy(*by, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("before") + F.sum("n").over(inside)
    near = near.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    held = [F.max(F.when((F.col("start") <= F.col(r)) & (F.col("end") > F.col(r)), F.col("value"))) for r in ("low", "high")]
    return near.groupBy(*by).agg(((held[0] + held[1]) / 2).alias("median"))


def rollup_medians(quotes: DataFrame, refs: DataFrame, levels: list[str], bucket_ms: int, accuracy: int | None = None) -> DataFrame:
    """Median spread and depth per level, over quotes: medians of symbols do not add up to that of a market.

    Quotes are counted by symbol, bucket and value before anything else, and these counts are joined, labelled and merged.
    accuracy asks for Spark's quantile sketches in place of the exact middle: mergeable, with a rank error of 1 / accuracy.
    """
    names = ("quoted_spread_bps", "top_of_book_depth")
    label = time_bucket_continuous(F.col("time_ms"), bucket_ms).alias("time_bucket")
    values = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in zip(names, ("spread", "size"))])
    ticks = _quotes(quotes).select("date", label, "sym", F.inline(values)).where("value is not null")
    counts = ticks.groupBy("date", "time_bucket", "sym", "name", "value").agg(F.count("*").alias("n"))
    counts = enrich(counts if accuracy is None else ticks, refs, "lotSize").where("lotSize > 0").withColumn(
        "value", F.when(F.col("name") == names[1], F.col("value") / F.col("lotSize")).otherwise(F.col("value")))
    by = [*_LEVEL_KEYS, "name"]
    if accuracy is None:
        merged = _by_level(counts, levels, "name", "value", "n").groupBy(*by, "value").agg(F.sum("n").alias("n"))
        medians = histogram_median(merged, by)
    else:
        medians = _by_level(counts, levels, "name", "value").groupBy(*by).agg(F.percentile_approx("value", 0.5, accuracy).alias("median"))
    return medians.groupBy(*_LEVEL_KEYS).agg(*[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in names])


def rollup_parkinson(trades: DataFrame, refs: DataFrame, levels: list[str], bucket_ms: int) -> DataFrame:
    """Range volatility per level: of a symbol from its range over the level's time, of a group the root mean square of its symbols'.

    The states are mergeable: least and greatest price per symbol, then sums of squared log ranges.
    """
    require_columns(trades, "date", "time_ms", "sym", "tradePrice", role="trades")
    label = time_bucket_continuous(F.col("time_ms"), bucket_ms).alias("time_bucket")
    ends = (F.max("high").alias("high"), F.min("low").alias("low"))
    price = trades.where("tradePrice > 0 and sym is not null").select("date", label, "sym", F.col("tradePrice").alias("high"), F.col("tradePrice").alias("low"))
    ranges = price.groupBy("date", "time_bucket", "sym").agg(*ends)
    scopes = F.array(F.struct(F.lit(True).alias("bucketed"), F.col("time_bucket").alias("b")), F.struct(F.lit(False).alias("bucketed"), F.lit(None).cast("string").alias("b")))
    scoped = ranges.select("date", "sym", "high", "low", F.inline(scopes)).groupBy("date", "bucketed", F.col("b").alias("time_bucket"), "sym").agg(*ends)
    squares = enrich(scoped, refs).withColumn("squares", F.pow(F.log(F.col("high") / F.col("low")), 2)).withColumn("symbols", F.lit(1))
    rows = _by_level(squares, levels, "bucketed", "squares", "symbols")
    named = [n for n in levels if n in LEVELS and "time_bucket" in LEVELS[n][2]]
    rows = rows.where(F.col("bucketed") == F.col("aggregationLevel").isin(*named))
    sums = rows.groupBy(*_LEVEL_KEYS).agg(F.sum("squares").alias("squares"), F.sum("symbols").alias("symbols"))
    return sums.select(*_LEVEL_KEYS, (10000 * F.sqrt(F.col("squares") / F.col("symbols") / (4 * F.log(F.lit(2.0))))).alias("parkinson_volatility_bps"), "symbols")


def fact_cells(trades: DataFrame, quotes: DataFrame, refs: DataFrame, bucket_ms: int) -> DataFrame:
    """All activity, liquidity and volatility facts, each table read once; a metric without ticks in a cell is null.

    Trades are aggregated once by clock bucket and auction phase; the few cells then go to both labels, as activity has
    buckets for auctions and volatility has none. A cell of trades and one of quotes are separate rows. has_activity,
    has_liquidity and has_volatility tell which facts a row carries.
    """
    require_columns(trades, "date", "time_ms", "sym", "session", "auction", "tradePrice", "tradeSize", role="trades")
    clock = time_bucket_continuous(F.col("time_ms"), bucket_ms)
    label = time_bucket(F.col("time_ms"), F.col("session"), F.col("auction"), bucket_ms)
    price, size = F.col("tradePrice"), F.when(F.col("tradeSize") > 0, F.col("tradeSize"))
    cells = trades.where("tradePrice > 0 and sym is not null").groupBy("date", clock.alias("clock"), label.alias("label"), "sym").agg(
        exact_sum(price * size).alias("turnover"), exact_sum(size).alias("volume"), F.count(size).alias("trade_count"), F.max(price).alias("high"), F.min(price).alias("low"))
    none = F.lit(None).cast("double")
    both = F.array(
        F.struct(F.col("label").alias("time_bucket"), "turnover", "volume", "trade_count", none.alias("high"), none.alias("low")),
        F.struct(F.col("clock").alias("time_bucket"), none.alias("turnover"), none.alias("volume"), F.lit(0).cast("long").alias("trade_count"), "high", "low"))
    traded = cells.select("date", "sym", F.inline(both)).groupBy("date", "time_bucket", "sym").agg(
        *[F.sum(c).alias(c) for c in ("turnover", "volume", "trade_count")], F.max("high").alias("high"), F.min("low").alias("low"))
    quoted = _quotes(quotes).groupBy("date", clock.alias("time_bucket"), "sym").agg(
        F.median("spread").alias("quoted_spread_bps"), F.median("size").alias("size"), F.lit(True).alias("has_quotes"))
    rows = enrich(traded.unionByName(quoted, allowMissingColumns=True), refs, "lotSize")
    spread = F.pow(F.log(F.col("high") / F.col("low")), 2)
    return rows.select(
        *KEYS, "turnover", "volume", "trade_count", "quoted_spread_bps", (F.col("size") / F.nullif("lotSize", F.lit(0))).alias("top_of_book_depth"),
        (10000 * F.sqrt(spread / (4 * F.log(F.lit(2.0))))).alias("parkinson_volatility_bps"), (F.col("trade_count") > 0).alias("has_activity"),
        (F.col("has_quotes") & (F.col("lotSize") > 0)).alias("has_liquidity"), F.col("high").isNotNull().alias("has_volatility"))


#: Metrics of a row of fact_cells by the column that tells whether the row carries them.
CELL_METRICS = {
    "has_activity": ("turnover", "volume", "trade_count"), "has_liquidity": ("quoted_spread_bps", "top_of_book_depth"),
    "has_volatility": ("parkinson_volatility_bps",)}


def observations(trades: DataFrame, quotes: DataFrame, refs: DataFrame, bucket_ms: int, group_by: tuple[str, ...] = ("sym",)) -> DataFrame:
    """All activity, liquidity and volatility observations."""
    carried = {m: flag for flag, names in CELL_METRICS.items() for m in names}
    return to_observations(fact_cells(trades, quotes, refs, bucket_ms), list(carried), group_by, carried=carried)
