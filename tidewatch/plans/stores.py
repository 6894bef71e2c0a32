"""Registered queries over stored ticks, source functions, the metric store and contracts, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.operators import asof, facts, observations
from tidewatch.plans import base
from tidewatch.plans.base import BUCKET_MS, HORIZONS, MAX_AGE_MS, TARGET, K, r, register, rounded, scored_sql
from tidewatch.sources import calendar, ticks
from tidewatch.sources.store import TickStore, on_dates, shared_folder

#: Days that the queries over sources ask for.
_FIRST, _LAST = "2024-01-29", TARGET
_DAYS = f"date BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}'"


def _days(load) -> list:
    return [row["date"] for row in calendar.trading_days(load("trades"), _FIRST, _LAST).orderBy("date").collect()]


def stored_sources(load, *roles: str) -> TickStore:
    """A store in the shared folder that holds the views of the roles."""
    views = {role: load(role) for role in roles}
    spark = next(iter(views.values())).sparkSession
    name = f"ticks_{uuid.uuid4().hex[:12]}"
    store = TickStore(spark, f"{shared_folder(spark)}/{name}", name)
    for role, df in views.items():
        store.write(role, df)
    return store


@register("sources_activity", f"SELECT {K}, {r('turnover', 'volume')}, trade_count FROM act WHERE {_DAYS}")
def sources_activity(load):
    """Activity of some days by source functions over a store: only their partitions are read, and neither the sums nor the reference join shuffle."""
    found = stored_sources(load, "trades", "refs").sources("trades", "refs").load(["turnover"], _days(load))
    return rounded(facts.activity(found["trades"], found["refs"], BUCKET_MS))


_TWO = ["turnover", "quoted_spread_bps"]


@register("store_fill", f"""SELECT metric_name, date, time_bucket, group_key, round(CASE WHEN date < DATE '2024-02-01' THEN value ELSE -value END, 6) AS value
    FROM obs WHERE {_DAYS} AND metric_name IN ('turnover', 'quoted_spread_bps')""")
def store_fill(load):
    """A metric store filled for some days, then for all: the second time only the absent days are computed, told by their sign."""
    days, sign = _days(load), 1

    def compute(dates, names) -> DataFrame:
        found = facts.observations(on_dates(load("trades"), dates), on_dates(load("quotes"), dates), on_dates(load("refs"), dates), BUCKET_MS)
        return found.where(F.col("metric_name").isin(names)).withColumn("value", sign * F.col("value"))

    spark = load("trades").sparkSession
    store = observations.StockStore(spark, f"{shared_folder(spark)}/metrics_{uuid.uuid4().hex[:12]}", "30m", _TWO)
    store.fill([d for d in days if d.isoformat() < "2024-02-01"], compute)
    sign = -1
    store.fill(days, compute)
    return rounded(store.read(days).drop("group"))


_RULES = {
    "refs": {"missing_key": "date IS NULL OR sym IS NULL", "blank_symbol": "sym = ''", "lot_size_not_positive": "lotSize <= 0"},
    "trades": {"missing_key": "date IS NULL OR sym IS NULL OR time_ms IS NULL", "time_outside_day": "time_ms < 0 OR time_ms >= 86400000", "price_not_positive": "tradePrice <= 0",
               "size_not_positive": "tradeSize <= 0", "unknown_auction": "auction NOT IN (0, 1, 2)", "unknown_session": "session NOT IN ('am', 'pm')"},
    "quotes": {"missing_key": "date IS NULL OR sym IS NULL OR time_ms IS NULL", "time_outside_day": "time_ms < 0 OR time_ms >= 86400000", "bid_not_positive": "bidPrice <= 0",
               "crossed_or_locked": "askPrice <= bidPrice", "negative_size": "bidSize < 0 OR askSize < 0"},
    "pts_quotes": {"missing_key": "date IS NULL OR sym IS NULL OR time_ms IS NULL", "time_outside_day": "time_ms < 0 OR time_ms >= 86400000", "missing_venue": "venue IS NULL OR venue = ''",
                   "bid_not_positive": "bidPrice <= 0", "crossed_or_locked": "askPrice <= bidPrice"},
}


@register("contract_violations", " UNION ALL ".join(
    f"SELECT '{role}' AS role, count(*) AS rows, '{rule}' AS rule, count(*) FILTER ({broken}) AS violations FROM {role}" for role, rules in _RULES.items() for rule, broken in rules.items()))
def contract_violations(load):
    return ticks.row_violations({role: load(role) for role in _RULES})


@register("reversion_venues", f"SELECT seq, venue, horizon, round(bps, 6) AS bps FROM {scored_sql('pts_quotes', chr(39) + 'X' + chr(39) + ' <> venue AND venue IN (' + chr(39) + 'SBIJ' + chr(39) + ', ' + chr(39) + 'ODX' + chr(39) + ')', 'venue = ' + chr(39) + 'JNX' + chr(39))} s")
def reversion_venues(load):
    """Trades of two of three venues against primary quotes of one of three."""
    quotes = load("pts_quotes")
    found = asof.score_reversion(load("pts_trades"), quotes, quotes, HORIZONS, MAX_AGE_MS, venues=("SBIJ", "ODX"), primary_venue="JNX")
    return rounded(found.select("seq", "venue", "horizon", "bps"))


@register("output_columns", """SELECT date, time_bucket, venue, horizon, sym, round(bps, 6) AS primary_quote_reversion_1m_bps, horizon_sort_order, trade_count, round(notional, 6) AS notional,
    round(positive_ratio, 6) AS positive_reversion_ratio, CAST(1 AS DOUBLE) AS valid_primary_quote_ratio, 7 AS context_sort_order, topixCapGrp FROM (""" + base.REVERSION + ") v WHERE horizon = '1m'")
def output_columns(load):
    """Reversion facts of one horizon through their output contract."""
    name = "primary_quote_reversion_1m_bps"
    rows = asof.reversion(base.scored(load), load("refs"), BUCKET_MS).where("horizon = '1m'").withColumnRenamed("primary_quote_reversion_bps", name)
    return rounded(observations.output_contract(name, ("sym",)).select(rows.withColumn("context_sort_order", F.lit(7))))


@register("symbol_scope", "SELECT metric_name, sym AS symbol, count(*) AS n, round(sum(value), 6) AS total FROM obs GROUP BY ALL")
def symbol_scope(load):
    """Symbol rows of observations, told by their group."""
    rows = base.observations(load).where(observations.is_symbol_scoped(F.col("group")))
    return rounded(rows.groupBy("metric_name", observations.symbol_of(F.col("group")).alias("symbol")).agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@register("first_days", "SELECT sym FROM trades WHERE sym IS NOT NULL GROUP BY sym ORDER BY min((date, time_ms, seq)) LIMIT 5")
def first_days(load):
    """The first five symbols of the tape in the order of their first trades."""
    return observations.first_seen(load("trades"), "sym", ["date", "time_ms", "seq"]).limit(5)


@register("dates_from_text", f"SELECT CAST(date AS VARCHAR) AS text, date FROM trades WHERE {_DAYS} UNION SELECT replace(CAST(date AS VARCHAR), '-', '.'), date FROM trades WHERE {_DAYS} UNION SELECT 'day ' || CAST(date AS VARCHAR), NULL FROM trades WHERE {_DAYS}")
def dates_from_text(load):
    """Dates read back from their ISO and dotted texts; other texts are no dates."""
    day = F.col("date").cast("string")
    texts = calendar.trading_days(load("trades"), _FIRST, _LAST).select(F.explode(F.array(day, F.replace(day, F.lit("-"), F.lit(".")), F.concat(F.lit("day "), day))).alias("text"))
    return texts.select("text", calendar.coerce_date(F.col("text")).alias("date"))


@register("signed_texts", "SELECT date, sym, CASE WHEN round(change, 6) >= 0 THEN '+' ELSE '' END || format('{:,.0f} JPY', round(change, 6)) AS text FROM (SELECT date, sym, sum(CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * tradePrice * tradeSize) / 3 AS change FROM trades GROUP BY ALL) t")
def signed_texts(load):
    """Texts of sums of money of both signs."""
    value = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1) * F.col("tradePrice") * F.col("tradeSize")
    rows = load("trades").groupBy("date", "sym").agg((facts.exact_sum(value) / 3).alias("change"))
    return rows.select("date", "sym", labels.signed_value_text(F.col("change"), F.lit("JPY")).alias("text"))
