"""Registered queries over ticks, facts, observations, comparisons and trends, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalars import symbol_anchor, time_bucket
from tidewatch.operators import asof, compare, facts, observations, trends
from tidewatch.plans import base
from tidewatch.plans.base import (
    BUCKET_MS, BUCKET_SQL, LEVELS, MAX_AGE_MS, METRICS, QUERIES, REVERSION, SCORED, SQL, TARGET, K, clock, compared, periods, r, register, rounded, scored)
from tidewatch.sources import calendar

CAP = ("topixCapGrp",)


def _obs(load, group: tuple[str, ...] = ("sym",)) -> DataFrame:
    return base.observations(load, group)


def _activity(load) -> DataFrame:
    return facts.activity(load("trades"), load("refs"), BUCKET_MS)


_CMP_SQL = ("SELECT metric_name, time_bucket, group_key, date, CAST(n AS BIGINT) AS reference_sample_size, round(value, 6) AS value, round(reference, 6) AS reference_value, round(z, 6) AS z_score, "
            "round(CASE WHEN n >= 10 THEN below END, 6) AS percentile, round(empirical_tail, 6) AS empirical_adverse_tail, round(normal_tail, 6) AS normal_adverse_tail, "
            "round(CASE WHEN z IS NOT NULL THEN cdf END, 6) AS normal_percentile, round(p5, 6) AS p5, round(p95, 6) AS p95, round(range_position_score, 6) AS range_position_score, "
            "round(change_abs, 6) AS change_abs, round(change_pct, 6) AS change_pct, confidence AS comparison_confidence, status, "
            "CASE WHEN n = 1 THEN 'comparison only: one reference observation, so z-score is undefined' "
            "WHEN n < 30 THEN 'low-confidence comparison: ' || n || ' reference observations; 30 required for headline z-score' END AS message FROM cmp")
_CMP = ("metric_name", "time_bucket", "group_key", "date", "reference_sample_size", "value", "reference_value", "z_score", "percentile", "empirical_adverse_tail",
        "normal_adverse_tail", "normal_percentile", "p5", "p95", "range_position_score", "change_abs", "change_pct", "comparison_confidence", "status", "message")


def _compared_columns(cmp: DataFrame) -> DataFrame:
    """Of a comparison, the columns of the SQL."""
    return rounded(cmp.select(*_CMP))


@register("activity", f"SELECT {K}, {r('turnover', 'volume')}, trade_count FROM act")
def activity(load):
    return rounded(_activity(load))


_SUMS = ("turnover", "volume", "trade_count")
_ROLL = " UNION ALL ".join(
    f"SELECT date, {'time_bucket' if 'bucket' in n else 'CAST(NULL AS VARCHAR)'} AS time_bucket, '{n}' AS aggregationLevel, '{kind}' AS groupType, "
    f"{chr(39) + 'TSE' + chr(39) if kind == 'market' else kind} AS groupValue, round(sum(turnover), 6) AS turnover, round(sum(volume), 6) AS volume, "
    "CAST(sum(trade_count) AS BIGINT) AS trade_count FROM act GROUP BY ALL" for n, (kind, _, _) in facts.LEVELS.items())


@register("activity_market_levels", _ROLL)
def activity_market_levels(load):
    return rounded(facts.rollup_levels(_activity(load), LEVELS, _SUMS))


_LABEL = " UNION ALL ".join(
    f"SELECT {K}, round(turnover, 6) AS turnover, '{n}' AS aggregationLevel, '{kind}' AS groupType, {chr(39) + 'TSE' + chr(39) if kind == 'market' else kind} AS groupValue FROM act"
    for n, (kind, _, _) in facts.LEVELS.items())


@register("label_levels", _LABEL)
def label_levels(load):
    return rounded(facts.label_levels(_activity(load).drop("volume", "trade_count"), LEVELS))


@register("pre_aggregate", "SELECT date, time_bucket, topixCapGrp, round(sum(turnover), 6) AS turnover, round(sum(volume), 6) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM act GROUP BY ALL")
def pre_aggregate(load):
    return rounded(facts.pre_aggregate(_activity(load)))


@register("liquidity", f"SELECT {K}, {r('quoted_spread_bps', 'top_of_book_depth')} FROM liq")
def liquidity(load):
    return rounded(facts.liquidity(load("quotes"), load("refs"), BUCKET_MS))


@register("parkinson", f"SELECT {K}, {r('parkinson_volatility_bps')} FROM vol")
def parkinson(load):
    return rounded(facts.parkinson(load("trades"), load("refs"), BUCKET_MS))


@register("time_bucket_labels", f"SELECT time_bucket, count(*) AS n FROM (SELECT {BUCKET_SQL} AS time_bucket FROM trades) x GROUP BY time_bucket")
def time_bucket_labels(load):
    label = time_bucket(F.col("time_ms"), F.col("session"), F.col("auction"), BUCKET_MS)
    return load("trades").groupBy(label.alias("time_bucket")).agg(F.count("*").alias("n"))


@register("universe_filter", "SELECT DISTINCT sym FROM refs WHERE length(sym) > 0 AND sym IN ('S1', 'S3', 'S7')")
def universe_filter(load):
    return calendar.universe(calendar.filter_universe(load("refs"), ["S1", "S3", "S7"]))


@register("reference_window", f"SELECT DISTINCT date FROM ticks WHERE date < DATE '{TARGET}' ORDER BY date DESC LIMIT 20")
def reference_window(load):
    return calendar.reference_window(load("ticks"), TARGET, 20)


def _asof_sql(keys: str, quotes: str, age: str = "") -> str:
    on = " AND ".join(f"t.{k} = q.{k}" for k in keys.split(", "))
    return f"""SELECT t.seq, t.date, t.sym, t.time_ms, {'CASE WHEN ' + age + ' THEN q.time_ms END' if age else 'q.time_ms'} AS r_time_ms,
        round({'CASE WHEN ' + age + ' THEN q.mid END' if age else 'q.mid'}, 6) AS r_mid
        FROM (SELECT * FROM pts_trades WHERE auction = 0) t ASOF LEFT JOIN
        (SELECT {keys}, time_ms, arg_max((bidPrice + askPrice) / 2, seq) AS mid FROM {quotes} WHERE askPrice > bidPrice AND bidPrice > 0 GROUP BY {keys}, time_ms) q
        ON {on} AND t.time_ms >= q.time_ms"""


def _asof(load, quotes: str, keys: list[str], **options) -> DataFrame:
    joined = asof.asof_join(load("pts_trades").where("auction = 0"), asof.mids(load(quotes)), keys, ["mid"], **options)
    return rounded(joined.select("seq", "date", "sym", "time_ms", "r_time_ms", "r_mid"))


@register("asof_pts_quote", _asof_sql("date, sym, venue", "pts_quotes"))
def asof_pts_quote(load):
    return _asof(load, "pts_quotes", ["date", "sym", "venue"])


@register("asof_primary_mid", _asof_sql("date, sym", "quotes"))
def asof_primary_mid(load):
    return _asof(load, "quotes", ["date", "sym"])


@register("asof_max_age", _asof_sql("date, sym", "quotes", f"t.time_ms - q.time_ms <= {MAX_AGE_MS}"))
def asof_max_age(load):
    return _asof(load, "quotes", ["date", "sym"], max_age=MAX_AGE_MS)


@register("asof_horizons", f"SELECT seq, horizon, round(bps, 6) AS bps FROM {SCORED} s")
def asof_horizons(load):
    return rounded(scored(load).select("seq", "horizon", "bps"))


@register("reversion_family", f"""SELECT date, time_bucket, venue, horizon, sym, topixCapGrp, round(bps, 6) AS primary_quote_reversion_bps, horizon_sort_order,
    round(positive_ratio, 6) AS positive_reversion_ratio, trade_count, round(notional, 6) AS notional, CAST(1 AS DOUBLE) AS valid_primary_quote_ratio FROM ({REVERSION}) v""")
def reversion_family(load):
    return rounded(asof.reversion(scored(load), load("refs"), BUCKET_MS))


@register("liquidity_market_levels", " UNION ALL ".join(
    f"SELECT date, {'time_bucket' if 'bucket' in n else 'CAST(NULL AS VARCHAR)'} AS time_bucket, '{n}' AS aggregationLevel, '{kind}' AS groupType, "
    f"{chr(39) + 'TSE' + chr(39) if kind == 'market' else kind} AS groupValue, round(median(10000 * (askPrice - bidPrice) / ((askPrice + bidPrice) / 2)), 6) AS quoted_spread_bps, "
    f"round(median((bidSize + askSize) / lotSize), 6) AS top_of_book_depth FROM (SELECT q.*, {clock('time_ms')} AS time_bucket, r.topixCapGrp, r.lotSize FROM quotes q JOIN refs r USING (date, sym)) x "
    "WHERE bidPrice > 0 AND askPrice > bidPrice AND lotSize > 0 GROUP BY ALL" for n, (kind, _, _) in facts.LEVELS.items()))
def liquidity_market_levels(load):
    return rounded(facts.rollup_medians(load("quotes"), load("refs"), LEVELS, BUCKET_MS))


def _level_sql(select: str, source: str, by: str = "") -> str:
    """A select over source for every level; {{b}} stands for the bucket that the level keeps."""
    return " UNION ALL ".join(
        f"SELECT date, {'time_bucket' if 'bucket' in n else 'CAST(NULL AS VARCHAR)'} AS time_bucket, '{n}' AS aggregationLevel, '{kind}' AS groupType, "
        f"{chr(39) + 'TSE' + chr(39) if kind == 'market' else kind} AS groupValue, {select} FROM ({source.format(b='time_bucket' if 'bucket' in n else 'CAST(NULL AS VARCHAR)')}) x "
        f"GROUP BY ALL" for n, (kind, _, _) in facts.LEVELS.items())


@register("volatility_levels", _level_sql(
    "round(10000 * sqrt(avg(pow(ln(high / low), 2)) / (4 * ln(2))), 6) AS parkinson_volatility_bps, count(*) AS symbols",
    f"""SELECT t.date, {{b}} AS time_bucket, t.sym, r.topixCapGrp, max(tradePrice) AS high, min(tradePrice) AS low FROM (SELECT *, {clock('time_ms')} AS time_bucket FROM trades) t
    LEFT JOIN refs r USING (date, sym) WHERE tradePrice > 0 AND sym IS NOT NULL GROUP BY ALL"""))
def volatility_levels(load):
    return rounded(facts.rollup_parkinson(load("trades"), load("refs"), LEVELS, BUCKET_MS))


@register("reversion_levels", _level_sql(
    "venue, horizon, round(sum(bps * notional) / sum(notional), 6) AS primary_quote_reversion_bps, min(horizon_sort_order) AS horizon_sort_order, "
    "round(avg(CASE WHEN bps > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_reversion_ratio, count(*) AS trade_count, round(sum(notional), 6) AS notional, "
    "CAST(1 AS DOUBLE) AS valid_primary_quote_ratio",
    f"SELECT s.*, {BUCKET_SQL} AS time_bucket, r.topixCapGrp FROM {SCORED} s LEFT JOIN refs r USING (date, sym)"))
def reversion_levels(load):
    return rounded(asof.rollup_reversion(asof.reversion_states(scored(load), BUCKET_MS), load("refs"), LEVELS))


@register("observations_long", f"SELECT metric_name, date, time_bucket, group_key, {r('value')} FROM obs")
def observations_long(load):
    return rounded(_obs(load).drop("group", "metadata"))


@register("observations_by_group", f"SELECT metric_name, date, time_bucket, group_key, {r('value')} FROM obs", group=CAP)
def observations_by_group(load):
    return rounded(_obs(load, CAP).drop("group", "metadata"))


_WIDE = ", ".join(f"round(max(CASE WHEN metric_name = '{m}' THEN value END), 6) AS {m}" for m in METRICS)
_WIDE_SQL = f"SELECT date, time_bucket AS timeBucket, '30m' AS bucketSize, sym, 'symbol' AS groupType, sym AS groupValue, {_WIDE} FROM obs GROUP BY date, time_bucket, sym"


@register("stock_metrics_wide", _WIDE_SQL)
def stock_metrics_wide(load):
    return rounded(observations.to_stock_metrics(_obs(load), "30m", METRICS))


@register("stock_metrics_by_group", f"""SELECT date, time_bucket AS timeBucket, '30m' AS bucketSize, 'ALL' AS sym, CASE WHEN topixCapGrp IS NULL THEN 'market' ELSE 'topixCapGrp' END AS groupType,
    coalesce(topixCapGrp, 'ALL') AS groupValue, {_WIDE} FROM obs GROUP BY date, time_bucket, topixCapGrp""", group=CAP)
def stock_metrics_by_group(load):
    return rounded(observations.to_stock_metrics(_obs(load, CAP), "30m", METRICS))


@register("stock_metrics_hydrate", "SELECT metric_name, date, time_bucket, group_key, round(value, 6) AS value FROM obs WHERE metric_name IN ('turnover', 'quoted_spread_bps')")
def stock_metrics_hydrate(load):
    wide = observations.to_stock_metrics(_obs(load), "30m", METRICS)
    return rounded(observations.from_stock_metrics(wide, ["turnover", "quoted_spread_bps", "absent"]).drop("group"))


@register("stock_metrics_merge", f"""SELECT date, time_bucket AS timeBucket, '30m' AS bucketSize, sym, 'symbol' AS groupType, sym AS groupValue,
    round(max(CASE WHEN metric_name = 'turnover' THEN CASE WHEN date >= DATE '{TARGET}' THEN 2 * value ELSE value END END), 6) AS turnover,
    round(max(CASE WHEN metric_name = 'volume' THEN value END), 6) AS volume FROM obs WHERE metric_name IN ('turnover', 'volume') GROUP BY date, time_bucket, sym""")
def stock_metrics_merge(load):
    obs = _obs(load).where("metric_name in ('turnover', 'volume')")
    later = obs.where((F.col("metric_name") == "turnover") & (F.col("date") >= TARGET)).withColumn("value", 2 * F.col("value"))
    return rounded(observations.merge_stock_metrics(
        observations.to_stock_metrics(obs, "30m", ["turnover", "volume"]), observations.to_stock_metrics(later, "30m", ["turnover"])))


@register("missing_metrics", f"SELECT DISTINCT t.date, m.metric_name FROM trades t, (VALUES ('turnover'), ('quoted_spread_bps')) AS m(metric_name) "
          f"WHERE t.date >= DATE '{TARGET}' OR m.metric_name = 'quoted_spread_bps' AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.date = t.date AND o.metric_name = m.metric_name)")
def missing_metrics(load):
    wanted = F.explode(F.array(F.lit("turnover"), F.lit("quoted_spread_bps"))).alias("metric_name")
    requested = load("trades").select("date").distinct().select("date", wanted)
    held = observations.to_stock_metrics(periods(load, _obs(load))[1], "30m", METRICS)
    return observations.missing_metrics(requested, held, ["turnover", "quoted_spread_bps"])


@register("cache_complete", f"""SELECT metric_name, date, time_bucket, group_key, round(CASE WHEN date >= DATE '{TARGET}' THEN -value ELSE value END, 6) AS value
    FROM obs WHERE metric_name IN ('turnover', 'quoted_spread_bps')""")
def cache_complete(load):
    obs, names = _obs(load), ["turnover", "quoted_spread_bps"]
    requested = obs.where(F.col("metric_name").isin(*names)).select("date", "metric_name").distinct()
    held = observations.to_stock_metrics(periods(load, obs)[1], "30m", METRICS)
    return rounded(observations.complete(requested, held, names, obs.withColumn("value", -F.col("value"))).drop("group"))


@register("reference_stats", f"SELECT metric_name, time_bucket, group_key, n, {r('mean', 'median', 'std', 'low', 'high', 'p5', 'p95', 'mad')} FROM stats")
def reference_stats(load):
    units = observations.collapse_units(periods(load, _obs(load))[1], compare.KEYS)
    return rounded(compare.reference_stats(units).drop("days", "distances"))


@register("compare_robust", _CMP_SQL)
def compare_robust(load):
    return _compared_columns(compared(load))


@register("compare_standard", _CMP_SQL, robust=False)
def compare_standard(load):
    return _compared_columns(compared(load, robust=False))


@register("compare_groups", _CMP_SQL, group=CAP)
def compare_groups(load):
    return _compared_columns(compared(load, group=CAP))


@register("compare_reversion", _CMP_SQL, reversion=True)
def compare_reversion(load):
    return _compared_columns(compare.compare_reversion_periods(base.reversion_obs(load), *base.in_periods(load)))


@register("group_deltas", """SELECT metric_name, group_key, round(current, 6) AS current, round(reference, 6) AS reference, round(current - reference, 6) AS delta FROM
    (SELECT metric_name, group_key, avg(value) AS current FROM cur GROUP BY ALL) a JOIN
    (SELECT metric_name, group_key, avg(v) AS reference FROM (SELECT metric_name, group_key, date, avg(value) AS v FROM ref GROUP BY ALL) b GROUP BY ALL) c
    USING (metric_name, group_key) ORDER BY abs(current - reference) DESC, metric_name, group_key LIMIT 12""", group=CAP)
def group_deltas(load):
    return rounded(compare.group_deltas(*periods(load, _obs(load, CAP))))


@register("daily_rollup", "SELECT metric_name, date, round(value, 6) AS value FROM daily")
def daily_rollup(load):
    return rounded(trends.daily_rollup(_obs(load)))


_LABEL_SQL = {
    "daily": "strftime(date, '%Y-%m-%d')", "yearly": "strftime(date, '%Y')",
    "weekly": "CAST(isoyear(date) AS VARCHAR) || '-W' || lpad(CAST(week(date) AS VARCHAR), 2, '0')", "monthly": "strftime(date, '%Y-%m')",
    "quarterly": "CAST(year(date) AS VARCHAR) || '-Q' || CAST(quarter(date) AS VARCHAR)",
}


def _trend(grain: str) -> None:
    @register(f"trend_series_{grain}", f"""SELECT metric_name, {_LABEL_SQL[grain]} AS period, round(CASE WHEN metric_name = 'turnover' THEN sum(value)
        WHEN metric_name IN ('quoted_spread_bps', 'top_of_book_depth') THEN median(value) WHEN metric_name LIKE '%volatility%' THEN sqrt(avg(value * value))
        ELSE avg(value) END, 6) AS value FROM daily GROUP BY metric_name, period""")
    def series(load):
        return rounded(trends.trend_series(_obs(load), grain))


for _grain in _LABEL_SQL:
    _trend(_grain)


_PAIRS = "idx a JOIN idx b ON a.metric_name = b.metric_name AND a.i < b.i"


@register("theil_sen", f"SELECT a.metric_name, round(median((b.value - a.value) / (b.i - a.i)), 6) AS slope FROM {_PAIRS} GROUP BY a.metric_name")
def theil_sen(load):
    return rounded(trends.theil_sen(trends.daily_rollup(_obs(load))))


_PHI = """CASE WHEN x < 7.07106781186547 THEN exp(-x*x/2) * ((((((3.52624965998911e-02*x + 0.700383064443688)*x + 6.37396220353165)*x + 33.912866078383)*x + 112.079291497871)*x
    + 221.213596169931)*x + 220.206867912376) / (((((((8.83883476483184e-02*x + 1.75566716318264)*x + 16.064177579207)*x + 86.7807322029461)*x + 296.564248779674)*x
    + 637.333633378831)*x + 793.826512519948)*x + 440.413735824752) ELSE 0 END"""
_KENDALL = """SELECT k.metric_name, k.n, tau, x, CASE WHEN tied = 0 AND k.n <= 33 THEN CASE WHEN 4 * least(d, p - d) = k.n * (k.n - 1) THEN 1
    ELSE least(1, 2 * CAST(list_sum(w.ways[1:CAST(least(d, p - d) AS BIGINT) + 1]) AS DOUBLE) / CAST(list_sum(w.ways) AS DOUBLE)) END END AS exact FROM (
    SELECT metric_name, n, p, tied, (p - s) / 2 AS d, s / sqrt(nullif(p * (p - tied), 0)) AS tau, abs(s) / sqrt(nullif((n * (n - 1) * (2 * n + 5) - y1) / 18, 0)) AS x FROM (
    SELECT a.metric_name, sum(sign(b.value - a.value)) AS s, CAST(count(*) AS DOUBLE) AS p FROM {t} a JOIN {t} b ON a.metric_name = b.metric_name AND a.i < b.i GROUP BY a.metric_name) q
    JOIN (SELECT metric_name, CAST(sum(t) AS DOUBLE) AS n, CAST(sum(t * (t - 1) * (2 * t + 5)) AS DOUBLE) AS y1, CAST(sum(t * (t - 1) / 2) AS DOUBLE) AS tied
    FROM (SELECT metric_name, value, count(*) AS t FROM {t} GROUP BY ALL) g GROUP BY metric_name) y USING (metric_name)) k LEFT JOIN ways w ON w.n = k.n"""
_P = f"coalesce(exact, least(1, 2 * {_PHI}), 1)"


_ROUNDED = "(SELECT metric_name, i, round(value, 9) AS value FROM {t})"
_KENDALL_SQL = "SELECT metric_name, round(coalesce(tau, 0), 6) AS tau, round({p}, 6) AS p_value FROM ({k}) k"


@register("kendall", _KENDALL_SQL.format(p=_P, k=_KENDALL.format(t=_ROUNDED.format(t="idx"))))
def kendall(load):
    return rounded(trends.kendall(trends.daily_rollup(_obs(load))))


@register("kendall_target", _KENDALL_SQL.format(p=_P, k=_KENDALL.format(t=_ROUNDED.format(t="cur_idx"))))
def kendall_target(load):
    """The target period is short: exact p-values."""
    return rounded(trends.kendall(trends.daily_rollup(periods(load, _obs(load))[0])))


_PREPARED = """(SELECT metric_name, date, i, CASE WHEN n >= 10 THEN v - avg(v) OVER (PARTITION BY metric_name, dayofweek(date)) + avg(v) OVER (PARTITION BY metric_name) ELSE v END AS value
    FROM (SELECT *, CASE WHEN f <> 0 THEN 100 * value / f ELSE value END AS v, count(*) OVER (PARTITION BY metric_name) AS n
    FROM (SELECT *, first_value(value) OVER (PARTITION BY metric_name ORDER BY date) AS f FROM {idx}) a) b)"""


def _classes(idx: str) -> str:
    t = _PREPARED.format(idx=idx)
    return f"""SELECT *, CASE WHEN n < 5 THEN 'insufficient' WHEN p_value >= 0.05 OR abs(norm) < 0.004 THEN 'fluctuating' ELSE
    CASE WHEN abs(norm) < 0.010 THEN 'mild' WHEN abs(norm) < 0.020 THEN 'moderate' ELSE 'strong' END || CASE WHEN slope > 0 THEN '_up_trend' ELSE '_down_trend' END END AS label
    FROM (SELECT metric_name, s.n, slope, coalesce(tau, 0) AS tau, {_P} AS p_value, coalesce(slope / nullif(base, 0), 0) AS norm FROM
    (SELECT metric_name, count(*) AS n, median(abs(value)) AS base FROM {t} t GROUP BY metric_name) s
    JOIN (SELECT a.metric_name, median((b.value - a.value) / (b.i - a.i)) AS slope FROM {t} a JOIN {t} b ON a.metric_name = b.metric_name AND a.i < b.i GROUP BY a.metric_name) t USING (metric_name)
    JOIN ({_KENDALL.format(t=_ROUNDED.format(t=t + ' u'))}) k USING (metric_name)) c"""


#: The trend's text of a row of classes.
TREND_TEXT_SQL = """CASE WHEN label = 'insufficient' THEN 'Insufficient observations for robust trend classification.' ELSE
    CASE WHEN label = 'fluctuating' THEN 'Target period has no clear directional trend' ELSE 'Target period shows a ' || replace(replace(label, '_trend', ' trend'), '_', ' ') END
    || format(' (p={:.3f}, normalized slope={:.3f}% per bucket).', p_value, norm * 100) END"""
_CLASS_SQL = f"""SELECT metric_name, label, round(tau, 6) AS tau, round(p_value, 6) AS p_value, round(slope, 6) AS slope, round(norm, 6) AS normalized_slope,
    {TREND_TEXT_SQL.replace("{", "{{").replace("}", "}}")} AS summary_text FROM ({{c}}) d"""


@register("classify_trend", _CLASS_SQL.format(c=_classes("idx")))
def classify_trend(load):
    return rounded(trends.classify_trend(trends.daily_rollup(_obs(load))))


@register("classify_trend_target", _CLASS_SQL.format(c=_classes("cur_idx")))
def classify_trend_target(load):
    return rounded(trends.classify_trend(trends.daily_rollup(periods(load, _obs(load))[0])))


@register("trend_comments", f"""SELECT metric_name, {TREND_TEXT_SQL} AS trend, format('Target-period mean is {{:.1f}}% ', 100 * abs(share)) || CASE WHEN share >= 0 THEN 'above' ELSE 'below' END
    || ' benchmark mean.' AS comparison FROM ({_classes("cur_idx")}) d JOIN
    (SELECT metric_name, (c - f) / abs(f) AS share FROM (SELECT metric_name, avg(value) FILTER (date >= DATE '{TARGET}') AS c, avg(value) FILTER (date < DATE '{TARGET}') AS f FROM daily GROUP BY metric_name) a) b
    USING (metric_name)""")
def trend_comments(load):
    return trends.trend_comments(*periods(load, _obs(load)))


@register("weekday_adjust", "SELECT metric_name, date, round(value - avg(value) OVER (PARTITION BY metric_name, dayofweek(date)) + avg(value) OVER (PARTITION BY metric_name), 6) AS value FROM daily")
def weekday_adjust(load):
    return rounded(trends.weekday_adjust(trends.daily_rollup(_obs(load))))


@register("rebase", "SELECT metric_name, date, round(CASE WHEN f = 0 THEN value ELSE 100 * value / f END, 6) AS value FROM (SELECT *, first_value(value) OVER (PARTITION BY metric_name ORDER BY date) AS f FROM daily) x")
def rebase(load):
    return rounded(trends.rebase(trends.daily_rollup(_obs(load))))


_ORDER = ("CASE {b} WHEN 'AMO' THEN 0 WHEN 'AMC' THEN 1000 WHEN 'PMO' THEN 2000 WHEN 'PMC' THEN 5000 ELSE CAST(substr({b}, 1, 2) AS INT) * 60 + CAST(substr({b}, 4, 2) AS INT) "
          "+ CASE WHEN {b} < '12' THEN 0 ELSE 2000 END END")
_DAY_SUMS = "(SELECT date, time_bucket, sum(turnover) AS value FROM act WHERE date {p} GROUP BY ALL)"
_REF_SUMS, _CUR_SUMS = _DAY_SUMS.format(p=f"< DATE '{TARGET}'"), _DAY_SUMS.format(p=f">= DATE '{TARGET}'")
_BOX = "round(quantile_cont({v}, 0.25), 6) AS q1, round(median({v}), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q3, round(min({v}), 6) AS low, round(max({v}), 6) AS high"


@register("activity_distribution", f"""SELECT c.time_bucket, c.o AS bucket_order, round(CASE WHEN c.total > 0 THEN 100 * c.running / c.total ELSE 0 END, 6) AS current, q1, median, q3, low, high FROM
    (SELECT *, sum(value) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS running, sum(value) OVER () AS total FROM (SELECT b.time_bucket, {_ORDER.format(b='b.time_bucket')} AS o, coalesce(m.value, 0) AS value
     FROM (SELECT DISTINCT time_bucket FROM act) b LEFT JOIN (SELECT time_bucket, avg(value) AS value FROM {_CUR_SUMS} s GROUP BY time_bucket) m USING (time_bucket)) x) c LEFT JOIN
    (SELECT time_bucket, {_BOX.format(v='share')} FROM (SELECT date, time_bucket, CASE WHEN sum(value) OVER (PARTITION BY date) > 0 THEN
    100 * sum(value) OVER (PARTITION BY date ORDER BY {_ORDER.format(b='time_bucket')} ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY date) ELSE 0 END AS share FROM
    (SELECT d.date, b.time_bucket, coalesce(s.value, 0) AS value FROM (SELECT DISTINCT date FROM act WHERE date < DATE '{TARGET}') d CROSS JOIN (SELECT DISTINCT time_bucket FROM act) b
     LEFT JOIN {_REF_SUMS} s ON s.date = d.date AND s.time_bucket = b.time_bucket) g) h GROUP BY time_bucket) z USING (time_bucket)""")
def activity_distribution(load):
    obs = _activity(load).select("date", "time_bucket", F.col("turnover").alias("value"))
    return rounded(trends.activity_distribution_periods(obs, *base.in_periods(load)))


_SEVEN = ("(VALUES ('AM opening auction', 'AMO'), ('AM continuous session', 'AM'), ('AM closing auction', 'AMC'), ('PM opening auction', 'PMO'), ('PM continuous session', 'PM'), "
          "('PM closing auction', 'PMC'), ('Other', 'Other')) AS n(session, code)")


@register("session_share", f"""SELECT session, round(coalesce(sum(share) / (SELECT count(DISTINCT date) FROM act), 0), 6) AS share FROM {_SEVEN} LEFT JOIN (
    SELECT code, 100 * value / sum(value) OVER (PARTITION BY date) AS share FROM (SELECT date, CASE WHEN time_bucket IN ('AMO', 'AMC', 'PMO', 'PMC') THEN time_bucket
    WHEN time_bucket < '12' THEN 'AM' ELSE 'PM' END AS code, sum(turnover) AS value FROM act GROUP BY ALL) x) y USING (code) GROUP BY session""")
def session_share(load):
    return rounded(trends.session_share(_activity(load).select("date", "time_bucket", F.col("turnover").alias("value"))))


@register("intraday_profile", f"""SELECT metric_name, time_bucket, {_ORDER.format(b='time_bucket')} AS bucket_order, round(current, 6) AS current, q1, median, q3, low, high FROM
    (SELECT metric_name, time_bucket, avg(value) AS current FROM cur GROUP BY ALL) a FULL JOIN
    (SELECT metric_name, time_bucket, {_BOX.format(v='v')} FROM (SELECT metric_name, date, time_bucket, avg(value) AS v FROM ref GROUP BY ALL) x GROUP BY ALL) b USING (metric_name, time_bucket)""")
def intraday_profile(load):
    return rounded(trends.intraday_profile(*periods(load, _obs(load))))


@register("symbol_anchor", "SELECT DISTINCT sym, 'symbol-detail-' || lower(sym) || '-' || substr(sha1(sym), 1, 8) AS anchor FROM ticks")
def symbol_anchors(load):
    return load("ticks").select("sym").distinct().select("sym", symbol_anchor(F.col("sym")).alias("anchor"))


@register("liquidity_stress", """SELECT time_bucket, group_key, date, round(max(CASE WHEN metric_name = 'quoted_spread_bps' THEN z END)
    + max(CASE WHEN metric_name = 'parkinson_volatility_bps' THEN z END) - max(CASE WHEN metric_name = 'top_of_book_depth' THEN z END), 6) AS stress
    FROM cmp GROUP BY time_bucket, group_key, date""")
def liquidity_stress(load):
    return rounded(compare.liquidity_stress(compared(load)))


import tidewatch.plans.reports  # noqa: E402,F401  registers the report queries
import tidewatch.plans.stores  # noqa: E402,F401  registers the queries over stores and sources


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(SQL)
