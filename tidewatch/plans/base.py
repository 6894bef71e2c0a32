"""What the registered queries share: the SQL of common parts, registration and rounding.

The SQL follows the survey, not the DataFrame code. Values are rounded to six digits in both forms, so that the order
of additions does not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalars import bucket_order
from tidewatch.operators import asof, compare, definitions, facts
from tidewatch.operators.observations import reversion_observations
from tidewatch.sources import calendar, ticks

BUCKET_MS = 1_800_000
MAX_AGE_MS = 1_800_000
HORIZONS = ["1m", "5m", "15m", "30m"]
TARGET = "2024-02-05"
#: Trading days of the reference window, which bounds the days of a key.
LOOKBACK = 35
METRICS = ["turnover", "volume", "trade_count", "quoted_spread_bps", "top_of_book_depth", "parkinson_volatility_bps"]
LEVELS = list(facts.LEVELS)

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
#: Group of an observation as JSON text, by the columns that make it.
GROUPS = {
    ("sym",): """'{"sym":"' || sym || '"}'""",
    ("topixCapGrp",): """CASE WHEN topixCapGrp IS NULL THEN '{}' ELSE '{"topixCapGrp":"' || topixCapGrp || '"}' END""",
}


def clock(t: str) -> str:
    s = f"({t} - {t} % {BUCKET_MS})"
    return (f"lpad(CAST({s} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({s} // 60000) % 60 AS VARCHAR), 2, '0') || ':' || "
            f"lpad(CAST(({s} // 1000) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({s} % 1000 AS VARCHAR), 3, '0')")


BUCKET_SQL = (
    "CASE WHEN auction = 1 AND session = 'am' THEN 'AMO' WHEN auction = 2 AND session = 'am' THEN 'AMC' "
    f"WHEN auction = 1 AND session = 'pm' THEN 'PMO' WHEN auction = 2 AND session = 'pm' THEN 'PMC' ELSE {clock('time_ms')} END")
K = "date, time_bucket, sym, topixCapGrp"

#: Common table expressions of the oracle, after the views.
PARTS = {
    "act": f"""SELECT {K}, sum(tradePrice * tradeSize) AS turnover, sum(tradeSize) AS volume, count(*) AS trade_count
        FROM (SELECT t.*, {BUCKET_SQL} AS time_bucket, r.topixCapGrp FROM trades t LEFT JOIN refs r USING (date, sym)) x
        WHERE tradePrice > 0 AND tradeSize > 0 AND sym IS NOT NULL GROUP BY {K}""",
    "liq": f"""SELECT {K}, median(10000 * (askPrice - bidPrice) / ((askPrice + bidPrice) / 2)) AS quoted_spread_bps,
        median((bidSize + askSize) / lotSize) AS top_of_book_depth
        FROM (SELECT q.*, {clock('time_ms')} AS time_bucket, r.topixCapGrp, r.lotSize FROM quotes q LEFT JOIN refs r USING (date, sym)) x
        WHERE bidPrice > 0 AND askPrice > bidPrice AND lotSize > 0 AND sym IS NOT NULL GROUP BY {K}""",
    "vol": f"""SELECT {K}, 10000 * sqrt(pow(ln(max(tradePrice) / min(tradePrice)), 2) / (4 * ln(2))) AS parkinson_volatility_bps
        FROM (SELECT t.*, {clock('time_ms')} AS time_bucket, r.topixCapGrp FROM trades t LEFT JOIN refs r USING (date, sym)) x
        WHERE tradePrice > 0 AND sym IS NOT NULL GROUP BY {K}""",
    "flat": " UNION ALL ".join(
        f"SELECT '{m}' AS metric_name, {K}, CAST({m} AS DOUBLE) AS value FROM {t}"
        for t, names in (("act", METRICS[:3]), ("liq", METRICS[3:5]), ("vol", METRICS[5:])) for m in names),
    "obs": "{obs}",
    "ref": f"SELECT * FROM obs WHERE date IN (SELECT DISTINCT date FROM trades WHERE date < DATE '{TARGET}' ORDER BY date DESC LIMIT {LOOKBACK})",
    "cur": f"SELECT * FROM obs WHERE date >= DATE '{TARGET}'",
    "defs": """SELECT * FROM (VALUES ('turnover', 'Turnover', 'JPY', CAST(NULL AS BOOLEAN)), ('volume', 'Volume', 'shares', NULL), ('trade_count', 'Trade Count', 'count', NULL),
        ('quoted_spread_bps', 'Quoted Spread', 'bps', FALSE), ('top_of_book_depth', 'Top-of-Book Depth', 'lots', TRUE),
        ('parkinson_volatility_bps', 'Parkinson Vola', 'bps', FALSE)) AS d(metric_name, label, unit, better)""",
    "notes": "SELECT * FROM (VALUES " + ", ".join(f"('{m[0]}', '{m[5]}')" for m in definitions.METRICS) + ") AS n(metric_name, interpretation)",
    "units": "SELECT metric_name, time_bucket, group_key, date, avg(value) AS value FROM ref GROUP BY ALL HAVING avg(value) IS NOT NULL",
    "mid": "SELECT metric_name, time_bucket, group_key, median(value) AS m FROM units GROUP BY ALL",
    "stats": """SELECT u.metric_name, u.time_bucket, u.group_key, count(value) AS n, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std,
        min(value) AS low, max(value) AS high, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, median(abs(value - m)) AS mad
        FROM units u JOIN mid USING (metric_name, time_bucket, group_key) GROUP BY ALL""",
    "shares": """SELECT c.metric_name, c.time_bucket, c.group_key, c.value, avg(CASE WHEN u.value <= c.value THEN 1.0 ELSE 0.0 END) AS below,
        avg(CASE WHEN u.value >= c.value THEN 1.0 ELSE 0.0 END) AS above, avg(CASE WHEN abs(u.value - m) >= abs(c.value - m) THEN 1.0 ELSE 0.0 END) AS apart
        FROM (SELECT DISTINCT metric_name, time_bucket, group_key, value FROM cur) c JOIN units u USING (metric_name, time_bucket, group_key)
        JOIN mid USING (metric_name, time_bucket, group_key) GROUP BY ALL""",
    "zs": """SELECT c.*, coalesce(s.n, 0) AS n, s.{centre} AS reference, s.p5, s.p95, h.below, h.above, h.apart, d.label, coalesce(d.unit, '') AS unit, {better} AS better,
        CASE WHEN coalesce(s.n, 0) >= 30 AND {width} <> 0 THEN (c.value - s.{centre}) / ({width}) END AS z
        FROM cur c LEFT JOIN stats s USING (metric_name, time_bucket, group_key) LEFT JOIN shares h USING (metric_name, time_bucket, group_key, value)
        LEFT JOIN defs d USING (metric_name)""",
    "phi": """SELECT *, CASE WHEN abs(z) < 7.07106781186547 THEN exp(-z*z/2)
        * ((((((3.52624965998911e-02*abs(z) + 0.700383064443688)*abs(z) + 6.37396220353165)*abs(z) + 33.912866078383)*abs(z) + 112.079291497871)*abs(z) + 221.213596169931)*abs(z) + 220.206867912376)
        / (((((((8.83883476483184e-02*abs(z) + 1.75566716318264)*abs(z) + 16.064177579207)*abs(z) + 86.7807322029461)*abs(z) + 296.564248779674)*abs(z) + 637.333633378831)*abs(z) + 793.826512519948)*abs(z) + 440.413735824752)
        ELSE exp(-z*z/2) / (abs(z) + 1/(abs(z) + 2/(abs(z) + 3/(abs(z) + 4/(abs(z) + 0.65))))) / 2.506628274631 END AS upper FROM zs""",
    "tails": "SELECT *, CASE WHEN z > 0 THEN 1 - upper ELSE upper END AS cdf FROM phi",
    "tail2": """SELECT *, CASE WHEN n >= 10 THEN CASE WHEN better THEN below WHEN NOT better THEN above ELSE apart END END AS empirical_tail,
        CASE WHEN better THEN cdf WHEN NOT better THEN 1 - cdf ELSE 2 * least(cdf, 1 - cdf) END AS normal_tail FROM tails""",
    "tail3": """SELECT * REPLACE (CASE WHEN z IS NULL THEN NULL ELSE normal_tail END AS normal_tail),
        CASE WHEN z IS NULL OR normal_tail = 0 THEN empirical_tail ELSE normal_tail END AS tail FROM tail2""",
    "cmp": """SELECT *, value - reference AS change_abs, (value - reference) / nullif(reference, 0) AS change_pct,
        CASE WHEN n >= 2 THEN 100 * (value - p5) / nullif(p95 - p5, 0) END AS range_position_score,
        CASE WHEN n < 10 THEN 'insufficient' WHEN n < 30 THEN 'weak' ELSE 'normal' END AS confidence,
        CASE WHEN n < 10 AND z IS NULL THEN 'comparison_only' WHEN tail <= 0.025 THEN 'alert' WHEN tail <= 0.10 THEN 'watch' WHEN tail IS NOT NULL THEN 'normal'
             WHEN abs(z) >= 2 THEN 'alert' WHEN abs(z) >= 1.5 THEN 'watch' ELSE 'normal' END AS status FROM tail3""",
    "daily": """SELECT metric_name, date, CASE WHEN metric_name = 'turnover' THEN sum(value) WHEN metric_name IN ('quoted_spread_bps', 'top_of_book_depth') THEN median(value)
        ELSE avg(value) END AS value FROM obs GROUP BY metric_name, date""",
    # exact distribution of discordant pairs, as numbers of orders of n untied values
    "ways": """SELECT n, ways FROM (WITH RECURSIVE w AS (SELECT 1 AS n, [CAST(1 AS HUGEINT)] AS ways UNION ALL
        SELECT n + 1, list_transform(range(CAST(n * (n + 1) / 2 + 1 AS BIGINT)), lambda d: list_sum(ways[greatest(d - n, 0) + 1:least(d, n * (n - 1) // 2) + 1])) FROM w WHERE n < 33)
        SELECT * FROM w)""",
    "cur_idx": f"SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY date) AS i FROM daily WHERE date >= DATE '{TARGET}'",
    "idx": "SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY date) AS i FROM daily",
}



_H = " UNION ALL ".join(f"SELECT '{h}' AS horizon, {h[:-1]} * 60000 AS h_ms, {i} AS horizon_sort_order" for i, h in enumerate(HORIZONS))
_MID = "(SELECT {k}, time_ms, arg_max((bidPrice + askPrice) / 2, seq) AS mid FROM {t} WHERE askPrice > bidPrice AND bidPrice > 0 AND {v} GROUP BY {k}, time_ms)"


def scored_sql(primary: str = "quotes", venues: str = "TRUE", primary_venue: str = "TRUE") -> str:
    """Scored trades, with the primary quotes' table and conditions on the venues of trades and venue quotes, and of primary quotes."""
    own, best = _MID.format(k="date, sym, venue", t="pts_quotes", v=venues), _MID.format(k="date, sym", t=primary, v=primary_venue)
    return f"""(SELECT *, side * 10000 * (post_mid - primary_mid) / post_mid AS bps FROM (
    SELECT t.*, p.mid AS pts_mid, p.time_ms AS pts_t, b.mid AS primary_mid, b.time_ms AS primary_t, a.mid AS post_mid, a.time_ms AS post_t,
        CASE WHEN t.tradePrice > p.mid THEN 1 WHEN t.tradePrice < p.mid THEN -1 ELSE 0 END AS side, t.tradePrice * t.tradeSize AS notional
    FROM (SELECT pt.*, h.*, pt.time_ms + h.h_ms AS post_at FROM pts_trades pt, ({_H}) h WHERE pt.auction = 0 AND {venues}) t
    ASOF LEFT JOIN {own} p ON t.date = p.date AND t.sym = p.sym AND t.venue = p.venue AND t.time_ms >= p.time_ms
    ASOF LEFT JOIN {best} b ON t.date = b.date AND t.sym = b.sym AND t.time_ms >= b.time_ms
    ASOF LEFT JOIN {best} a ON t.date = a.date AND t.sym = a.sym AND t.post_at >= a.time_ms) x
    WHERE time_ms - pts_t <= {MAX_AGE_MS} AND time_ms - primary_t <= {MAX_AGE_MS} AND post_at - post_t <= {MAX_AGE_MS} AND side <> 0 AND post_mid > 0 AND primary_mid IS NOT NULL)"""


SCORED = scored_sql()
REVERSION = f"""SELECT date, time_bucket, venue, horizon, sym, topixCapGrp, sum(bps * notional) / sum(notional) AS bps,
    min(horizon_sort_order) AS horizon_sort_order, avg(CASE WHEN bps > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio, count(*) AS trade_count, sum(notional) AS notional
    FROM (SELECT s.*, {BUCKET_SQL} AS time_bucket, r.topixCapGrp FROM {SCORED} s LEFT JOIN refs r USING (date, sym)) y GROUP BY date, time_bucket, venue, horizon, sym, topixCapGrp"""
_REV_OBS = f"""SELECT 'primary_quote_reversion_' || horizon || '_bps' AS metric_name, date, time_bucket, sym, topixCapGrp,
    '{{"horizon":"' || horizon || '","sym":"' || sym || '","venue":"' || venue || '"}}' AS group_key, bps AS value, venue, horizon, trade_count, notional, horizon_sort_order
    FROM ({REVERSION}) r"""


def oracle(select: str, robust: bool = True, group: tuple[str, ...] = ("sym",), reversion: bool = False, market: bool = False) -> str:
    """The SQL of a query over the common parts; market asks for the market summary beside them."""
    parts = dict(PARTS)
    if reversion:
        parts = {"obs": _REV_OBS, **{n: q for n, q in parts.items() if n not in ("act", "liq", "vol", "flat", "obs")}}
    else:
        parts["obs"] = f"SELECT *, {GROUPS[group]} AS group_key FROM flat"
    if market:
        parts["market"] = MARKET_SQL
    text = ",\n".join(f"{n} AS ({q})" for n, q in parts.items()).replace("{better}", "FALSE" if reversion else "d.better")
    text = text.replace("{centre}", "median" if robust else "mean").replace("{width}", "1.4826 * s.mad" if robust else "s.std")
    return f"{ticks.with_clause()},\n{text}\n{select}"


PRIORITY_SQL = "CASE status WHEN 'alert' THEN 0 WHEN 'watch' THEN 1 WHEN 'comparison_only' THEN 2 ELSE 3 END"
SEVERITY_SQL = (f"{PRIORITY_SQL}, coalesce(round(abs(z), 6), 0) DESC, coalesce(round(abs(change_pct), 6), 0) DESC, metric_name, date NULLS FIRST, time_bucket NULLS FIRST, group_key, value NULLS FIRST")
REPORT_SQL = f"{PRIORITY_SQL}, coalesce(round(abs(z), 6), 0) DESC, coalesce(label, metric_name), date NULLS FIRST, time_bucket NULLS FIRST, group_key, metric_name, value NULLS FIRST"


def _central(column: str) -> str:
    return f"CASE WHEN c.metric_name LIKE '%volatility%' THEN sqrt(avg(c.{column} * c.{column})) ELSE avg(c.{column}) END"


#: The survey's D25: buckets collapsed per metric, date and group; symbol rows are not in the observations it is used with.
MARKET_SQL = f"""SELECT metric_name, date, CAST(NULL AS VARCHAR) AS time_bucket, group_key, topixCapGrp, label, unit, better, value, reference, value - reference AS change_abs,
    (value - reference) / nullif(reference, 0) AS change_pct, z, percentile, status, n FROM (
    SELECT c.metric_name, c.date, c.group_key, min(c.topixCapGrp) AS topixCapGrp, min(c.label) AS label, min(c.unit) AS unit, bool_or(c.better) AS better,
    {_central('value')} AS value, {_central('reference')} AS reference, nullif(CAST(sum(c.n) AS BIGINT), 0) AS n, min(w.z) AS z, min(w.percentile) AS percentile, min(w.status) AS status
    FROM cmp c JOIN (SELECT metric_name, date, group_key, z, status, CASE WHEN n >= 10 THEN below END AS percentile, row_number() OVER (PARTITION BY metric_name, date, group_key
        ORDER BY {PRIORITY_SQL}, coalesce(round(abs(z), 6), 0) DESC, coalesce(round(abs(change_pct), 6), 0) DESC, time_bucket, value) AS k FROM cmp) w
    ON w.k = 1 AND c.metric_name = w.metric_name AND c.date = w.date AND c.group_key = w.group_key GROUP BY c.metric_name, c.date, c.group_key) m"""


def register(name: str, sql: str, **options):
    """Registers a query, a function of a loader of views, beside its SQL."""

    def add(query: Callable[[Callable], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: query(lambda view: ticks.load(spark, sf_dir, view))
        SQL[name] = oracle(sql, **options)
        return query

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits; a zero loses its sign."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


def observations(load, group: tuple[str, ...] = ("sym",)) -> DataFrame:
    return facts.observations(load("trades"), load("quotes"), load("refs"), BUCKET_MS, group)


def in_periods(load) -> tuple:
    """Conditions on an observation's date: target, and the LOOKBACK trading days before it as literals, which reach the scans."""
    days = [row["date"] for row in calendar.reference_window(load("trades"), TARGET, LOOKBACK).collect()]
    return F.col("date") >= F.lit(TARGET).cast("date"), F.col("date").isin(days)


def periods(load, obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Target and reference part of observations."""
    target, reference = in_periods(load)
    return obs.where(target), obs.where(reference)


def compared(load, robust: bool = True, group: tuple[str, ...] = ("sym",)) -> DataFrame:
    return compare.compare_periods(observations(load, group), *in_periods(load), robust=robust)


def scored(load) -> DataFrame:
    return asof.score_reversion(load("pts_trades"), load("pts_quotes"), load("quotes"), HORIZONS, MAX_AGE_MS, primary_venue="TSE")


def reversion_obs(load, context: bool = False) -> DataFrame:
    """Reversion observations; context adds an order of contexts from the last bucket of a day to the first."""
    found = asof.reversion(scored(load), load("refs"), BUCKET_MS)
    found = found.withColumn("context_sort_order", 10_000 - bucket_order(F.col("time_bucket"))) if context else found
    return reversion_observations(found)
