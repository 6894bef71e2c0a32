"""Backward as-of joins and the reversion facts built on them.

Times are milliseconds of a day. Sides are dealt by keys and blocks of time, so that the day of a busy symbol is not one task.
Rows without time match nothing; of right rows of equal time that with the greatest tie counts. An empty side gives nulls
or, in the reversion family, no rows. Repeated left rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalars import auction_phase, bucket_start, clock_label, duration_ms
from tidewatch.operators.facts import enrich, rollup_levels

#: Milliseconds of a block of time, and those of a day.
BLOCK_MS, DAY_MS = 7_200_000, 86_400_000

#: Partitions of the reversion family's exchange for each of the session's shuffle partitions.
SPREAD = 4


def _block(time: Column, block_ms: int) -> Column:
    """Number of a time's block; times before the day fall into the first, times after it into the last."""
    return F.least(F.greatest(F.floor(time / block_ms), F.lit(0)), F.lit(DAY_MS // block_ms - 1)).cast("int")


def _seen(time: Column, before: int, after: int, block_ms: int) -> Column:
    """The blocks of the times from which a row at this time can be seen: up to before milliseconds earlier, after later."""
    return F.sequence(_block(time - before, block_ms), _block(time + after, block_ms))


def _blocks_seen(time: Column, before: int, after: int, block_ms: int) -> Column:
    return F.explode(_seen(time, before, after, block_ms)).alias("__b")


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """A row for each of its blocks, as __b; none where they are null.

    The condition stands on the block, not on the row's columns: a filter on these is evaluated below the expressions that make
    them, and repeats those for each mention, which over computed columns took most of the scan.
    """
    return rows.select("*", F.explode_outer(blocks).alias("__b")).where(F.col("__b").isNotNull())


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], values: list[str], left_time: str = "time_ms", right_time: str = "time_ms",
    tie: str = "seq", prefix: str = "r_", max_age: int | None = None, block_ms: int = BLOCK_MS,
) -> DataFrame:
    """All columns of left and the values of the last right row of the same keys at or before its time.

    One union, one exchange by keys and block, one window. With max_age a right row goes to the blocks from which it is not
    yet older than that; without, the last right row of a block, found by partial aggregation, goes to all later blocks of
    the day. An unmatched row, one without time, or one whose match is older than max_age, gives nulls.
    """
    packed = F.struct(F.col(right_time).alias("time_ms"), F.col(tie).alias("__tie"), *[F.col(v) for v in values if v != "time_ms"])
    timed = right.where(F.col(right_time).isNotNull())
    if max_age is not None:
        quotes = timed.select(*keys, F.col(right_time).alias("__t"), packed.alias("__r"), _blocks_seen(F.col(right_time), 0, max_age, block_ms))
    else:
        quotes = timed.select(*keys, F.col(right_time).alias("__t"), packed.alias("__r"), _block(F.col(right_time), block_ms).alias("__b"))
        if block_ms < DAY_MS:
            ends = quotes.groupBy(*keys, "__b").agg(F.max("__t").alias("__t"), F.max("__r").alias("__r"))
            later = F.explode(F.sequence(F.col("__b") + 1, F.lit(DAY_MS // block_ms - 1)))
            quotes = quotes.unionByName(ends.where(F.col("__b") < DAY_MS // block_ms - 1).withColumn("__b", later))
    rows = left.select("*", F.col(left_time).alias("__t"), _block(F.col(left_time), block_ms).alias("__b"), F.lit(True).alias("__left"))
    # sorted by time and then right rows first, so that every row's frame ends with itself and equal times are seen
    order = Window.partitionBy(*keys, "__b").orderBy("__t", F.col("__left").isNotNull())
    last = F.max("__r").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.unionByName(quotes, allowMissingColumns=True).withColumn("__f", F.when(F.col("__t").isNotNull(), last)).where("__left")
    if max_age is not None:
        found = found.withColumn("__f", F.when(F.col("__t") - F.col("__f.time_ms") <= max_age, F.col("__f")))
    return found.select(*left.columns, F.col("__f.time_ms").alias(f"{prefix}time_ms"), *[
        F.col(f"__f.{v}").alias(f"{prefix}{v}") for v in values if v != "time_ms"])


def mids(quotes: DataFrame, venues: tuple[str, ...] = ()) -> DataFrame:
    """Quotes that are neither crossed nor locked, of the venues (none listed: all), with their mid."""
    valid = quotes.where("bidPrice > 0 and askPrice > bidPrice and sym is not null and venue is not null")
    valid = valid.where(F.col("venue").isin(*venues)) if venues else valid
    return valid.withColumn("mid", (F.col("bidPrice") + F.col("askPrice")) / 2)


def score_reversion(
    trades: DataFrame, pts_quotes: DataFrame, primary: DataFrame, horizons: list[str], max_age: int, exclude_auction: bool = True,
    venues: tuple[str, ...] = (), primary_venue: str | None = None, block_ms: int = BLOCK_MS,
) -> DataFrame:
    """Scored trades of the venues (none listed: all) at all horizons: signed reversion in basis points.

    Trades, the venues' quotes and the primary quotes meet in one exchange by date, symbol and block. A quote goes to every
    block with trades that can use it: none may be older than max_age, and a primary quote may come up to the longest
    horizon after a trade. There the venue's mid is the latest by one sort, the primary mid at a trade's time and at each horizon
    are those of growing ranges of time over a second sort within the same exchange.
    """
    valid = F.expr("tradePrice > 0 and tradeSize > 0 and sym is not null and venue is not null and time_ms is not null")
    valid = valid & F.col("venue").isin(*venues) if venues else valid
    valid = valid & (F.col("auction") == 0) if exclude_auction else valid
    steps = [(h, duration_ms(h)) for h in horizons]
    reach = max((ms for _, ms in steps), default=0)
    time = F.col("time_ms")

    def quoted(quotes: DataFrame, name: str, before: int) -> DataFrame:
        latest = F.struct("time_ms", "seq", "mid").alias(name)
        return _dealt(quotes.select("date", "sym", "venue", "time_ms", time.alias("__t"), latest), _seen(time, before, max_age, block_ms)).drop("time_ms")

    names = [c for c in trades.columns if c not in ("horizon", "h_ms", "horizon_sort_order", "post")]
    events = _dealt(trades.select(*names, time.alias("__t"), F.lit(True).alias("__trade")), F.when(valid, F.array(_block(time, block_ms))))
    events = events.unionByName(quoted(mids(pts_quotes, venues), "__pts", 0), allowMissingColumns=True)
    events = events.unionByName(quoted(mids(primary, (primary_venue,) if primary_venue else ()), "__primary", reach), allowMissingColumns=True)
    # a fixed number of partitions, which are not joined again by their packed size: sorts and windows hold many times that
    partitions = SPREAD * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = events.repartition(partitions, "date", "sym", "__b")
    # the venue's mid comes first: venue quotes, and trades without a side, then spare the second sort and its ranges, and no row carries these twice
    by_venue = Window.partitionBy("date", "sym", "__b", "venue").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    side = F.when(F.col("tradePrice") > F.col("__own.mid"), 1).when(F.col("tradePrice") < F.col("__own.mid"), -1).otherwise(0)
    own = events.withColumn("__own", F.max("__pts").over(by_venue)).withColumn("side", side)
    sided = F.col("__trade") & (time - F.col("__own.time_ms") <= max_age) & (F.col("side") != 0)
    own = own.where(F.col("__primary").isNotNull() | sided).withColumn("__own", F.col("__own.mid")).drop("__pts")
    by_time = Window.partitionBy("date", "sym", "__b").orderBy("__t")

    def latest_at(ms: int) -> Column:
        return F.max("__primary").over(by_time.rangeBetween(Window.unboundedPreceding, ms))

    states = own.select("*", latest_at(0).alias("__before"), *[latest_at(ms).alias(f"__after_{i}") for i, (_, ms) in enumerate(steps)])
    fresh = F.col("__trade") & (time - F.col("__before.time_ms") <= max_age)
    looks = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(ms).cast("long").alias("h_ms"), F.lit(i).alias("horizon_sort_order"), F.col(f"__after_{i}").alias("post"))
                      for i, (h, ms) in enumerate(steps)])
    rows = states.where(fresh).select(
        *names, "side", F.col("__own").alias("pts_mid"), F.col("__before.mid").alias("primary_mid"), F.inline(looks))
    scored = rows.where((time + F.col("h_ms") - F.col("post.time_ms") <= max_age) & (F.col("post.mid") > 0) & F.col("primary_mid").isNotNull())
    bps = F.col("side") * 10000 * (F.col("post.mid") - F.col("primary_mid")) / F.col("post.mid")
    return scored.withColumn("post_mid", F.col("post.mid")).withColumn("bps", bps).withColumn("notional", F.col("tradePrice") * F.col("tradeSize")).drop("post")


#: Sums that reversion facts are made of; they add up over symbols, buckets and venues.
REVERSION_SUMS = ("weighted_bps", "notional", "positive_count", "trade_count")


def reversion_states(scored: DataFrame, bucket_ms: int) -> DataFrame:
    """Additive reversion sums by date, bucket, venue, horizon and symbol."""
    phase = auction_phase(F.col("session"), F.col("auction"))
    start = F.when(phase.isNull(), bucket_start(F.col("time_ms"), bucket_ms))
    # buckets are numbers until the sums are made; a label for each scored trade took more than a quarter of the stage
    sums = scored.groupBy("date", phase.alias("__phase"), start.alias("__start"), "venue", "horizon", "sym").agg(
        F.sum(F.col("bps") * F.col("notional")).alias("weighted_bps"), F.sum("notional").alias("notional"),
        F.count_if(F.col("bps") > 0).alias("positive_count"), F.count("*").alias("trade_count"), F.min("horizon_sort_order").alias("horizon_sort_order"))
    label = F.coalesce("__phase", clock_label(F.col("__start")))
    return sums.select("date", label.alias("time_bucket"), "venue", "horizon", "sym", *REVERSION_SUMS, "horizon_sort_order")


def finish_reversion(states: DataFrame, *keys: str) -> DataFrame:
    """Reversion facts of additive sums: notional-weighted mean and share of positive ones."""
    return states.select(
        *keys, (F.col("weighted_bps") / F.col("notional")).alias("primary_quote_reversion_bps"), "horizon_sort_order",
        (F.col("positive_count") / F.col("trade_count")).alias("positive_reversion_ratio"), "trade_count", "notional",
        F.lit(1.0).alias("valid_primary_quote_ratio"))


def reversion(scored: DataFrame, refs: DataFrame, bucket_ms: int) -> DataFrame:
    """Notional-weighted reversion by date, bucket, venue, horizon, symbol and capitalisation group."""
    return finish_reversion(enrich(reversion_states(scored, bucket_ms), refs), "date", "time_bucket", "venue", "horizon", "sym", "topixCapGrp")


def rollup_reversion(states: DataFrame, refs: DataFrame, levels: list[str]) -> DataFrame:
    """Reversion per level, venue and horizon, from the additive sums of symbols."""
    keys = ("date", "time_bucket", "aggregationLevel", "groupType", "groupValue", "venue", "horizon")
    sums = rollup_levels(enrich(states, refs), levels, REVERSION_SUMS, ("venue", "horizon", "horizon_sort_order"))
    return finish_reversion(sums, *keys)
