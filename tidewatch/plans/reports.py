"""Registered queries of the report tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.functions.scalars import bucket_order
from tidewatch.operators import commentary, compare, definitions, observations, overview, reversion, trends
from tidewatch.plans import base
from tidewatch.plans.base import PRIORITY_SQL, REPORT_SQL, SEVERITY_SQL, TARGET, compared, periods, r, register, rounded
from tidewatch.sources import calendar
from tidewatch.sources.store import written

CAP = ("topixCapGrp",)
BUCKET_LABEL = ("CASE {b} WHEN 'AMO' THEN 'AM opening auction' WHEN 'AMC' THEN 'AM closing auction' WHEN 'PMO' THEN 'PM opening auction' "
                "WHEN 'PMC' THEN 'PM closing auction' ELSE {b} END")
_B = BUCKET_LABEL.format(b="time_bucket")
_ORDER = ("CASE {b} WHEN 'AMO' THEN 0 WHEN 'AMC' THEN 1000 WHEN 'PMO' THEN 2000 WHEN 'PMC' THEN 5000 ELSE CAST(substr({b}, 1, 2) AS INT) * 60 + CAST(substr({b}, 4, 2) AS INT) "
          "+ CASE WHEN {b} < '12' THEN 0 ELSE 2000 END END").format(b="time_bucket")
_G = "'TOPIX cap group: ' || topixCapGrp"
_SCOPE = f"concat_ws(', ', 'Date: ' || CAST(date AS VARCHAR), 'Intraday bucket: ' || {_B}, {_G})"
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count" for s in compare.PRIORITY)
_SUMS = ", ".join(f"CAST(sum({s}_count) AS BIGINT) AS {s}_count" for s in compare.PRIORITY)
_WORST = "CASE WHEN min({p}) = 0 THEN 'alert' WHEN min({p}) = 1 THEN 'watch' WHEN min({p}) = 2 THEN 'comparison_only' ELSE 'normal' END".format(p=PRIORITY_SQL)


def _text(value: str, unit: str, sign: str = "") -> str:
    value = f"round({value}, 6)"
    plus = f"CASE WHEN {value} >= 0 THEN '+' ELSE '' END || " if sign else ""
    return (f"CASE WHEN {value} IS NULL THEN 'not available' WHEN {unit} = 'count' THEN {plus}format('{{:,.0f}}', {value}) WHEN {unit} = 'JPY' THEN {plus}format('{{:,.0f}} JPY', {value}) "
            f"WHEN {unit} <> '' THEN {plus}format('{{:,.4f}} ', {value}) || {unit} ELSE {plus}format('{{:,.4f}}', {value}) END")


_SIGNED = "CASE WHEN round(change_pct, 6) >= 0 THEN '+' ELSE '' END || format('{:.1f}%', round(100 * change_pct, 6))"
_CHANGE = f"nullif(concat_ws(' ', CASE WHEN change_abs IS NOT NULL THEN 'change ' || {_text('change_abs', 'unit', '+')} END, CASE WHEN change_pct IS NOT NULL THEN {_SIGNED} END), '')"


def _cap(load) -> DataFrame:
    return compared(load, group=CAP)


def _summary(load) -> DataFrame:
    return overview.market_summary(_cap(load))


@register("status_counts", "SELECT metric_name, status, count(*) AS n FROM cmp GROUP BY ALL")
def status_counts(load):
    return overview.status_counts(compared(load))


_OVERVIEW = f"""SELECT o.*, s.most_severe_scope FROM (SELECT metric_name, min(label) AS label, {_WORST} AS status, count(*) AS n, {_COUNTS}, round(avg(value), 6) AS mean_value, round(avg(reference), 6) AS mean_reference_value,
    round(avg(change_abs), 6) AS mean_change_abs, round(avg(change_pct), 6) AS mean_change_pct FROM cmp GROUP BY metric_name) o JOIN
    (SELECT metric_name, {_SCOPE} AS most_severe_scope, row_number() OVER (PARTITION BY metric_name ORDER BY {PRIORITY_SQL}, coalesce(round(abs(z), 6), 0) DESC, date, time_bucket, group_key) AS k FROM cmp) s
    ON s.k = 1 AND o.metric_name = s.metric_name"""


@register("metric_overview", f"SELECT * EXCLUDE (label) FROM ({_OVERVIEW}) v", group=CAP)
def metric_overview(load):
    return rounded(overview.metric_overview(_cap(load)))


@register("family_overview", f"""SELECT family, {_WORST} AS status, CAST(sum(n) AS BIGINT) AS n, {_SUMS}, string_agg(label, ', ' ORDER BY place) AS metrics,
    arg_min(label, k) AS leading_metric FROM (SELECT *, CASE WHEN metric_name IN ('turnover', 'volume', 'trade_count') THEN 'Market activity' WHEN metric_name IN ('quoted_spread_bps', 'top_of_book_depth')
    THEN 'Displayed liquidity' END AS family, list_position(['turnover', 'volume', 'trade_count', 'quoted_spread_bps', 'top_of_book_depth'], metric_name) AS place,
    row_number() OVER (ORDER BY {PRIORITY_SQL}, alert_count + watch_count DESC, lower(label), metric_name) AS k FROM ({_OVERVIEW}) v) f WHERE family IS NOT NULL GROUP BY family""", group=CAP)
def family_overview(load):
    return overview.family_overview(_cap(load))


_MARKET_COLUMNS = f"metric_name, date, group_key, {r('value', 'reference')}, {r('change_abs', 'change_pct', 'z', 'percentile')}, status, n"


def _market(df: DataFrame) -> DataFrame:
    return rounded(df.select(
        "metric_name", "date", "group_key", "value", F.col("reference_value").alias("reference"), "change_abs", "change_pct", F.col("z_score").alias("z"), "percentile",
        "status", F.col("reference_sample_size").alias("n")))


@register("market_summary", f"SELECT {_MARKET_COLUMNS} FROM market", group=CAP, market=True)
def market_summary(load):
    return _market(_summary(load))


_LEVEL = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY {SEVERITY_SQL}) AS k FROM market) m WHERE k = 1)"


@register("metric_level_summary", f"SELECT {_MARKET_COLUMNS} FROM {_LEVEL} l", group=CAP, market=True)
def metric_level_summary(load):
    return _market(overview.metric_level_summary(_summary(load)))


_SYM_ORDER = f"{PRIORITY_SQL}, coalesce(least(normal_tail, empirical_tail), 1), coalesce(round(abs(z), 6), 0) DESC, coalesce(round(abs(change_pct), 6), 0) DESC, metric_name, date, time_bucket"
_ANOMALIES = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY {_SYM_ORDER}) AS k FROM cmp WHERE status <> 'normal') x WHERE k = 1 ORDER BY {_SYM_ORDER}, sym LIMIT 20)"


@register("symbol_anomalies", f"SELECT sym AS symbol, metric_name, date, time_bucket, status, round(z, 6) AS z_score FROM {_ANOMALIES} a")
def symbol_anomalies(load):
    return rounded(overview.symbol_anomalies(compared(load)).select("symbol", "metric_name", "date", "time_bucket", "status", "z_score"))


@register("symbol_detail_index", f"SELECT sym AS symbol, status, metric_name, n AS rows FROM (SELECT sym, status, metric_name FROM {_ANOMALIES} a) b JOIN (SELECT sym, count(*) AS n FROM cur GROUP BY sym) c USING (sym)")
def symbol_detail_index(load):
    current, _ = periods(load, base.observations(load))
    anomalies = overview.symbol_anomalies(compared(load))
    return overview.symbol_detail_index(anomalies, overview.symbol_series(current, anomalies))


def _top(name: str, by: str) -> None:
    key = "metric_name" if by == "metric" else (
        "CASE WHEN metric_name IN ('turnover', 'volume', 'trade_count') THEN 'Market activity' WHEN metric_name IN ('quoted_spread_bps', 'top_of_book_depth') THEN 'Displayed liquidity' ELSE metric_name END")
    top = (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {SEVERITY_SQL}) AS k FROM cmp WHERE status IN ('alert', 'watch')) x "
           f"ORDER BY k > 1, {SEVERITY_SQL} LIMIT 5)")

    @register(name, f"SELECT metric_name, group_key, date, time_bucket, status, round(z, 6) AS z_score FROM {top} t", group=CAP)
    def top_changes(load):
        return rounded(overview.top_changes(_cap(load), by).select("metric_name", "group_key", "date", "time_bucket", "status", "z_score"))

    if by == "metric":
        @register("driver_intensity", f"""SELECT metric_name, group_key, date, time_bucket, CAST(greatest(8, round_even(100 * abs(z) / max(abs(z)) OVER (), 0)) AS INT) AS intensity
            FROM {top} t WHERE z IS NOT NULL""", group=CAP)
        def driver_intensity(load):
            return overview.driver_intensity(overview.top_changes(_cap(load), by)).select("metric_name", "group_key", "date", "time_bucket", "intensity")

        @register("narrative", f"""SELECT metric_name, date, time_bucket, coalesce(label, metric_name) || ' ' || CASE WHEN change_pct IS NULL THEN 'changed' WHEN abs(change_pct) < 0.01 THEN 'was flat'
            WHEN change_pct > 0 THEN CASE WHEN better THEN 'increased' ELSE 'rose' END ELSE CASE WHEN better THEN 'decreased' ELSE 'declined' END END
            || CASE WHEN change_pct IS NULL THEN '' ELSE format(' {{:.0f}}%', round(100 * abs(change_pct), 6)) END
            || coalesce(' in ' || nullif(concat_ws(', ', topixCapGrp, CASE WHEN time_bucket IN ('AMO', 'AMC', 'PMO', 'PMC') THEN time_bucket || ' auction' END), ''), '') || '. ' || interpretation AS sentence FROM {top} t JOIN notes USING (metric_name)""", group=CAP)
        def narrative(load):
            rows = definitions.with_definitions(overview.top_changes(_cap(load), by), "label", "interpretation")
            text = labels.narrative(F.coalesce("label", "metric_name"), F.col("interpretation"), F.col("change_pct"), F.col("change_abs"), F.col("higher_is_better"), F.col("group"), F.col("time_bucket"))
            return rows.select("metric_name", "date", "time_bucket", text.alias("sentence"))


_top("top_changes", "metric")
_top("top_changes_by_family", "family")


@register("drilldown_rows", f"""SELECT metric_name, date, time_bucket, topixCapGrp AS dimension_value, status, round(magnitude, 6) AS magnitude FROM
    (SELECT *, greatest(coalesce(round(abs(z), 6), 0), coalesce(round(abs(change_pct), 6), 0), coalesce(round(abs(change_abs), 6), 0)) AS magnitude FROM cmp WHERE topixCapGrp IS NOT NULL) x
    ORDER BY {PRIORITY_SQL}, magnitude DESC, topixCapGrp, metric_name, date, time_bucket, group_key, value LIMIT 60""", group=CAP)
def drilldown_rows(load):
    return rounded(overview.drilldown_rows(_cap(load), n=60).select("metric_name", "date", "time_bucket", "dimension_value", "status", "magnitude"))


_TWO = "metric_name IN ('quoted_spread_bps', 'top_of_book_depth') AND topixCapGrp IS NOT NULL"


@register("group_metric_matrix", f"""SELECT group_value, metric_name, round(change, 6) AS change, round(z, 6) AS z, round(score, 6) AS score, group_value = first_value(group_value) OVER (ORDER BY score DESC, group_value) AS is_default
    FROM (SELECT *, sum(abs(coalesce(change, 0))) OVER (PARTITION BY group_value) AS score FROM (SELECT topixCapGrp AS group_value, metric_name, avg(change_pct) * 100 AS change, avg(z) AS z
    FROM cmp WHERE {_TWO} GROUP BY ALL) a) b""", group=CAP)
def group_metric_matrix(load):
    return rounded(overview.group_metric_matrix(_cap(load)))


@register("group_daily_trend", f"""SELECT g.group_value, g.metric_name, d.date, round(m.value, 6) AS value FROM (SELECT DISTINCT topixCapGrp AS group_value, metric_name FROM cmp WHERE {_TWO}) g
    CROSS JOIN (SELECT DISTINCT date FROM cmp WHERE {_TWO}) d LEFT JOIN (SELECT topixCapGrp AS group_value, metric_name, date, avg(value) AS value FROM cmp WHERE {_TWO} GROUP BY ALL) m
    ON m.group_value = g.group_value AND m.metric_name = g.metric_name AND m.date = d.date""", group=CAP)
def group_daily_trend(load):
    return rounded(overview.group_daily_trend(_cap(load)))


@register("group_heatmap", """SELECT metric_name, label, group_value, round(change_pct, 6) AS change_pct, rank FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY coalesce(round(abs(change_pct), 6), 0) DESC, group_value) AS rank,
    count(*) OVER (PARTITION BY metric_name) AS n FROM (SELECT metric_name, label, topixCapGrp AS group_value, arg_max(change_pct, abs(change_pct)) AS change_pct FROM cmp
    WHERE topixCapGrp IS NOT NULL GROUP BY ALL) a) b WHERE rank <= 10 AND n >= 2""", group=CAP)
def group_heatmap(load):
    return rounded(overview.group_heatmap(_cap(load)))


@register("delta_bars", f"""SELECT metric_name, date, group_key, round(change_pct, 6) AS change_pct, CAST(round_even(100 * abs(change_pct) / max(abs(change_pct)) OVER (), 0) AS INT) AS width
    FROM (SELECT * FROM market ORDER BY coalesce(round(abs(change_pct), 6), 0) DESC, {SEVERITY_SQL} LIMIT 8) t""", group=CAP, market=True)
def delta_bars(load):
    return rounded(overview.delta_bars(_summary(load)).select("metric_name", "date", "group_key", "change_pct", "width"))


@register("signal_callout", """SELECT alerts, watches, n, round(change, 6) AS change, 'Quoted Spread is ' || CASE WHEN change >= 0 THEN 'up' ELSE 'down' END || format(' {:.1f}% versus reference. ', round(100 * abs(change), 6))
    || format('Status mix: {} alerts, {} watch rows across {} market contexts.', alerts, watches, n) AS comment FROM (SELECT count(*) FILTER (status = 'alert') AS alerts,
    count(*) FILTER (status = 'watch') AS watches, count(*) AS n, avg(change_pct) AS change FROM market WHERE metric_name = 'quoted_spread_bps') x""", group=CAP, market=True)
def signal_callout(load):
    return rounded(overview.signal_callout(_summary(load)))


_TABLE = f"""metric_name, coalesce(label, metric_name) AS label, {_text('value', 'unit')} AS value_text, CASE WHEN reference IS NOT NULL THEN {_text('reference', 'unit')} END AS reference_text,
    {_CHANGE} AS change_text, status, {_SCOPE} AS scope"""


@register("comparison_table", f"SELECT {_TABLE} FROM (SELECT * FROM market ORDER BY {REPORT_SQL} LIMIT 40) t", group=CAP, market=True)
def comparison_table(load):
    return overview.comparison_table(_summary(load), 40)


@register("drilldown_table", f"""SELECT 'TOPIX cap group' AS dimension, topixCapGrp AS dimension_value, {_TABLE} FROM (SELECT * FROM
    (SELECT *, greatest(coalesce(round(abs(z), 6), 0), coalesce(round(abs(change_pct), 6), 0), coalesce(round(abs(change_abs), 6), 0)) AS magnitude FROM cmp WHERE topixCapGrp IS NOT NULL) x
    ORDER BY {PRIORITY_SQL}, magnitude DESC, topixCapGrp, metric_name, date, time_bucket, group_key, value LIMIT 25) t""", group=CAP)
def drilldown_table(load):
    return overview.drilldown_table(_cap(load))


_SYM_SCOPE = f"concat_ws(', ', 'Date: ' || CAST(date AS VARCHAR), 'Intraday bucket: ' || {_B}, 'Sym: ' || sym)"


@register("symbol_table", f"""SELECT sym AS symbol, place, {_TABLE.replace(_SCOPE, _SYM_SCOPE)} FROM (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY {REPORT_SQL}) AS place
    FROM cmp WHERE sym IN (SELECT sym FROM {_ANOMALIES} a)) t WHERE place <= 25""")
def symbol_table(load):
    cmp = compared(load)
    return overview.symbol_table(cmp, overview.symbol_anomalies(cmp))


@register("kpi_snapshot", f"SELECT {_TABLE}, CAST(list_position(['turnover', 'quoted_spread_bps', 'top_of_book_depth'], metric_name) AS BIGINT) AS place FROM {_LEVEL} l "
          "WHERE metric_name IN ('turnover', 'quoted_spread_bps', 'top_of_book_depth')", group=CAP, market=True)
def kpi_snapshot(load):
    return overview.kpi_snapshot(overview.metric_level_summary(_summary(load)))


_DIRECTION = "CASE WHEN round(change_abs, 6) > 0 THEN 'higher' WHEN round(change_abs, 6) < 0 THEN 'lower' WHEN round(change_abs, 6) = 0 THEN 'unchanged' ELSE 'changed' END"
_CAVEATS = """concat_ws(' ', CASE WHEN n = 0 THEN 'No comparable reference observations were available.' WHEN n = 1 THEN 'One reference observation; z-score is intentionally omitted.'
    WHEN n < 30 THEN 'Low confidence: ' || n || ' reference observations; statistical scores are limited.' END,
    CASE WHEN z IS NULL AND n < 30 THEN 'No z-score shown because fewer than 30 comparable observations were available.' END, 'Reference observation unit: trading day.')"""
_FACT = f"""SELECT *, coalesce(label, metric_name) AS metric_label, coalesce(nullif(concat_ws(', ', 'Sym: ' || sym, 'Intraday bucket: ' || {_B}), ''), 'the selected universe') AS group_label,
    {_text('value', 'unit')} AS value_text, CASE WHEN reference IS NOT NULL THEN {_text('reference', 'unit')} END AS reference_text, {_CHANGE} AS change_text, {_DIRECTION} AS direction_word, {_CAVEATS} AS caveat FROM cmp"""
_COMMENT = """CASE WHEN status = 'normal' THEN metric_label || ' was within the normal range for ' || group_label || '.'
    WHEN status = 'comparison_only' THEN metric_label || ' comparison for ' || group_label || ': current ' || value_text || coalesce(' versus reference ' || reference_text, '')
        || coalesce(' (' || change_text || ')', '') || '; statistical score not shown.'
    ELSE metric_label || ' was ' || direction_word || ' for ' || group_label || ': current ' || value_text || coalesce(' versus reference ' || reference_text, '')
        || coalesce(' (' || change_text || ')', '') || coalesce(format(' with z-score {:.1f}', round(z, 6)), '') || '.' END || ' Caveats: ' || caveat"""


@register("commentary_text", f"SELECT metric_label, group_label, status, {_COMMENT} AS comment FROM ({_FACT}) f ORDER BY {PRIORITY_SQL}, coalesce(round(abs(z), 6), 0) DESC, metric_label, group_label, value_text LIMIT 50")
def commentary_text(load):
    facts = commentary.order_facts(commentary.commentary_facts(compared(load)), 50)
    return commentary.commentary_text(facts).select("metric_label", "group_label", "status", "comment")


_PLURAL = "{c} || CASE WHEN {c} = 1 THEN ' {w}' ELSE ' {w}s' END"


@register("section_summary", f"""SELECT CASE WHEN alert_count > 0 THEN 'alert' WHEN watch_count > 0 THEN 'watch' WHEN comparison_only_count > 0 THEN 'comparison_only' ELSE 'normal' END AS status,
    'Market headline: ' || {_PLURAL.format(c='alert_count', w='alert')} || ', ' || {_PLURAL.format(c='watch_count', w='watch item')} || ', ' || {_PLURAL.format(c='comparison_only_count', w='comparison-only item')}
    || ', and ' || {_PLURAL.format(c='normal_count', w='normal item')} || ' across ' || {_PLURAL.format(c='n', w='comparison')} || ' in all symbols.' AS comment FROM (SELECT count(*) AS n, {_COUNTS} FROM cmp) c""")
def section_summary(load):
    return commentary.commentary_text(commentary.section_summary(compared(load), "Market", "all symbols")).select("status", "comment")


@register("dominant_method", "SELECT CASE WHEN count(*) > 0 THEN 'robust' ELSE 'same_intraday_bucket' END AS comparison_method FROM cmp")
def dominant_method(load):
    return commentary.dominant_method(compared(load))


_TABLES = ("top_changes", "drivers", "status_counts", "metrics", "families")


@register("executive_overview", """SELECT 'top_changes' AS part, least(5, count(*)) AS n FROM {t} t
    UNION ALL SELECT 'drivers', count(*) FROM (SELECT z FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY {s}) AS k FROM {t} t) x ORDER BY k > 1, {s} LIMIT 5) y WHERE z IS NOT NULL
    UNION ALL SELECT 'status_counts', count(*) FROM (SELECT DISTINCT metric_name, status FROM cmp) s UNION ALL SELECT 'metrics', count(DISTINCT metric_name) FROM cmp
    UNION ALL SELECT 'families', count(DISTINCT CASE WHEN metric_name IN ('turnover', 'volume', 'trade_count') THEN 1 WHEN metric_name IN ('quoted_spread_bps', 'top_of_book_depth') THEN 2 END) FROM cmp""".format(
    s=SEVERITY_SQL, t="(SELECT * FROM cmp WHERE status IN ('alert', 'watch'))"), group=CAP)
def executive_overview(load):
    """Rows of each of the overview's tables, which share one written comparison."""
    tables = overview.executive_overview(written(_cap(load)))
    counts = [tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("part"), "n") for t in _TABLES]
    return observations.flatten(*counts)


@register("keep_first", f"SELECT metric_name, group_key, date, time_bucket, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric_name, group_key ORDER BY date, {_ORDER}, time_bucket, value) AS k FROM obs) x WHERE k = 1")
def keep_first(load):
    """The first observation of each metric and symbol in market order."""
    found = observations.keep_first(base.observations(load), ["metric_name", "group_key"], ["date", bucket_order(F.col("time_bucket")), "time_bucket", "value"])
    return rounded(found.select("metric_name", "group_key", "date", "time_bucket", "value"))


_PERIOD_VALUE = """SELECT metric_name, CASE WHEN metric_name = 'turnover' THEN avg(total) WHEN metric_name LIKE '%volatility%' THEN sqrt(sum(squares) / sum(n)) ELSE avg(rolled) END AS value FROM
    (SELECT metric_name, date, sum(value) AS total, sum(value * value) AS squares, count(*) AS n, CASE WHEN metric_name IN ('quoted_spread_bps', 'top_of_book_depth') THEN median(value) ELSE avg(value) END AS rolled
    FROM {t} GROUP BY metric_name, date) d GROUP BY metric_name"""


@register("overview_cards", f"""SELECT place, card, metric_name, round(value, 6) AS value, round(change_pct, 6) AS change_pct, CASE WHEN metric_name = 'turnover' THEN
    CASE WHEN value >= 1e12 THEN format('{{:.1f}}T JPY', round(value / 1e12, 6)) WHEN value >= 1e9 THEN format('{{:.1f}}B JPY', round(value / 1e9, 6)) WHEN value >= 1e6 THEN format('{{:.1f}}M JPY', round(value / 1e6, 6)) ELSE format('{{:,.0f}} JPY', round(value, 6)) END
    WHEN metric_name = 'top_of_book_depth' THEN format('{{:,.4f}} lots', round(value, 6)) ELSE format('{{:.1f}} bps', round(value, 6)) END AS value_text,
    CASE WHEN change_pct IS NULL THEN 'no comparison' WHEN change_pct = 0 THEN '0.0%' WHEN change_pct > 0 THEN '↑ ' || format('{{:.1f}}%', round(100 * change_pct, 6)) ELSE '↓ ' || format('{{:.1f}}%', round(-100 * change_pct, 6)) END AS delta_text,
    CASE WHEN change_pct IS NULL OR change_pct = 0 THEN 'flat' WHEN change_pct > 0 THEN 'up' ELSE 'down' END AS direction
    FROM (SELECT v.place, v.card, v.metric_name, c.value, (c.value - f.value) / nullif(f.value, 0) AS change_pct FROM
    (VALUES (1, 'Traded Value', 'turnover'), (2, 'Quoted Spread', 'quoted_spread_bps'), (3, 'Top of book Depth', 'top_of_book_depth'), (4, 'Volatility', 'parkinson_volatility_bps')) AS v(place, card, metric_name)
    JOIN ({_PERIOD_VALUE.format(t='cur')}) c USING (metric_name) LEFT JOIN ({_PERIOD_VALUE.format(t='ref')}) f USING (metric_name)) x""")
def overview_cards(load):
    return rounded(trends.overview_cards(*periods(load, base.observations(load))))


_WEEK = "CAST(isoyear(date) AS VARCHAR) || '-W' || lpad(CAST(week(date) AS VARCHAR), 2, '0')"


@register("spark_bars", f"""SELECT metric_name, label, round(value, 6) AS value, round(CASE WHEN high > low THEN 28 + 68 * (value - low) / (high - low) ELSE 55 END, 6) AS height,
    round(greatest(0, least(100, CASE WHEN high > low THEN 28 + 68 * (m - low) / (high - low) ELSE 55 END)), 6) AS mean_height FROM
    (SELECT *, min(value) OVER (PARTITION BY metric_name) AS low, max(value) OVER (PARTITION BY metric_name) AS high FROM
    (SELECT metric_name, {_WEEK} AS label, avg(v) AS value FROM (SELECT metric_name, date, avg(value) AS v FROM ref GROUP BY ALL) d GROUP BY ALL) w) b
    JOIN (SELECT metric_name, avg(value) AS m FROM cur GROUP BY metric_name) c USING (metric_name)""")
def spark_bars(load):
    """The 35 reference days are more than a bar each, so that they are binned by week."""
    current, reference = periods(load, base.observations(load))
    return rounded(trends.spark_bars(reference, current))


_FOLDED = """SELECT metric_name, {p} AS label, CASE WHEN metric_name = 'turnover' THEN sum(value) WHEN metric_name IN ('quoted_spread_bps', 'top_of_book_depth') THEN median(value)
    WHEN metric_name LIKE '%volatility%' THEN sqrt(avg(value * value)) ELSE avg(value) END AS value FROM daily WHERE date {c} DATE '{t}' GROUP BY 1, 2"""


@register("trend_payload", f"""SELECT metric_name, label, round(value, 6) AS value, period, round(avg(value) OVER (PARTITION BY metric_name, period), 6) AS period_mean FROM (
    SELECT *, 'benchmark' AS period FROM ({_FOLDED.format(p=_WEEK, c='<', t=TARGET)}) a UNION ALL SELECT *, 'target' AS period FROM ({_FOLDED.format(p=_WEEK, c='>=', t=TARGET)}) b) x""")
def trend_payload(load):
    return rounded(trends.trend_payload(*periods(load, base.observations(load)), "weekly"))


_PLACE = f"row_number() OVER (PARTITION BY metric_name ORDER BY date, {_ORDER}, time_bucket, group_key, value)"


@register("chart_points", f"SELECT metric_name, place, date, {_B} AS bucket, 'Sym: ' || sym AS label, round(value, 6) AS value FROM (SELECT *, {_PLACE} AS place FROM cur) x WHERE place <= 100")
def chart_points(load):
    return rounded(trends.chart_points(periods(load, base.observations(load))[0], 100))


def _chart(x: str, series: str, rows: str, metadata: str) -> str:
    """The first 50 points of each metric; rows are observations with their unit and period."""
    place = f"row_number() OVER (PARTITION BY metric_name ORDER BY period, date, {_ORDER}, time_bucket, group_key, value)"
    return (f"SELECT metric_name, place, {x} AS x_text, {_B} AS bucket_text, {series} AS series_text, {_text('value', 'unit')} AS value_text, {metadata} AS metadata_text, round(value, 6) AS value "
            f"FROM (SELECT *, {place} AS place FROM ({rows}) o) x WHERE place <= 50")


_TARGET_ROWS = "SELECT c.*, d.unit, 'target' AS period FROM cur c JOIN defs d USING (metric_name)"
_BOTH_ROWS = f"{_TARGET_ROWS} UNION ALL SELECT c.*, d.unit, 'reference' AS period FROM ref c JOIN defs d USING (metric_name)"


@register("chart_time_series", _chart(f"CAST(date AS VARCHAR) || ' ' || {_B}", "'Sym: ' || sym", _TARGET_ROWS, "CAST(NULL AS VARCHAR)"))
def chart_time_series(load):
    return rounded(trends.chart_table(periods(load, base.observations(load))[0], n=50))


@register("chart_intraday", _chart(_B, "'Sym: ' || sym", _TARGET_ROWS, "CAST(NULL AS VARCHAR)"))
def chart_intraday(load):
    return rounded(trends.chart_table(periods(load, base.observations(load))[0], "intraday", 50))


@register("chart_reference_target", _chart("CAST(date AS VARCHAR)", f"'Sym: ' || sym || ', Intraday bucket: ' || {_B}", _BOTH_ROWS, "'Period: ' || period"))
def chart_reference_target(load):
    current, reference = periods(load, base.observations(load))
    return rounded(trends.chart_table(current, "reference_target", 50, reference))


@register("heatmap_cells", f"""SELECT metric_name, place, {_B} AS x, topixCapGrp AS y, round(value, 6) AS value, {_text('value', 'unit')} AS value_text
    FROM (SELECT c.*, d.unit, {_PLACE.replace('metric_name', 'c.metric_name')} AS place FROM cur c JOIN defs d USING (metric_name) WHERE topixCapGrp IS NOT NULL) x WHERE place <= 100""", group=CAP)
def heatmap_cells(load):
    return rounded(trends.heatmap_cells(periods(load, base.observations(load, CAP))[0], "topixCapGrp", 100))


@register("report_arrays", """SELECT metric_name, group_key, count(*) AS n, round(sum(value), 6) AS total FROM cur GROUP BY ALL""")
def report_arrays(load):
    """Chart arrays of each series, read back: their lengths and totals."""
    packed = observations.report_arrays(periods(load, base.observations(load))[0], ["metric_name", "group_key"], ["date", "time_bucket"], ["date", "time_bucket", "value"])
    points = F.from_json("points", "array<struct<date:date,time_bucket:string,value:double>>")
    return rounded(packed.select("metric_name", "group_key", F.size(points).cast("long").alias("n"), F.aggregate(points, F.lit(0.0), lambda t, p: t + p["value"]).alias("total")))


@register("period_text", """SELECT min(CAST(date AS VARCHAR)) || ' to ' || max(CAST(date AS VARCHAR)) || ' (' || count(DISTINCT date) || ' days)' AS period_text FROM cur""")
def period_text(load):
    return trends.period_text(periods(load, base.observations(load))[0])


_REASONS = """concat_ws('; ', CASE WHEN trade_count < 2 THEN 'trade_count ' || trade_count || ' < 2' END,
    CASE WHEN notional < 5000000 THEN 'notional ' || CAST(notional AS BIGINT) || ' < 5000000' END)"""
_POINTS = f"(SELECT *, value AS reversion_bps, '{{\"sym\":\"' || sym || '\"}}' AS rest, {_REASONS} AS reasons FROM obs)"


def _points(load, context: bool = False) -> DataFrame:
    return reversion.flag_confidence(reversion.curve_points(base.reversion_obs(load, context)), 2, 5_000_000.0)


@register("curve_points", f"SELECT date, time_bucket, venue, horizon, rest AS group_key, {r('reversion_bps', 'notional')}, trade_count, CAST(horizon_sort_order AS INT) AS horizon_sort_order FROM {_POINTS} p", reversion=True)
def curve_points(load):
    return rounded(_points(load).select("date", "time_bucket", "venue", "horizon", "group_key", "reversion_bps", "notional", "trade_count", "horizon_sort_order"))


@register("confidence_flags", f"SELECT date, time_bucket, venue, horizon, rest AS group_key, reasons <> '' AS low_confidence, reasons FROM {_POINTS} p", reversion=True)
def confidence_flags(load):
    return _points(load).select("date", "time_bucket", "venue", "horizon", "group_key", "low_confidence", F.array_join("confidence_reasons", "; ").alias("reasons"))


_CONTEXTS = (f"(SELECT date, time_bucket, rest AS group_key, max(greatest(reversion_bps, 0)) AS max_positive, max(abs(reversion_bps)) AS max_absolute, count(*) FILTER (reasons <> '') AS low_count, "
             f"avg(CASE WHEN reasons <> '' THEN 1.0 ELSE 0.0 END) AS low_ratio FROM {_POINTS} p GROUP BY ALL)")
_CONTEXT_COLUMNS = f"date, time_bucket, group_key, {r('max_positive', 'max_absolute')}, low_count, round(low_ratio, 6) AS low_ratio"


@register("reversion_contexts", f"SELECT {_CONTEXT_COLUMNS} FROM {_CONTEXTS} c", reversion=True)
def reversion_contexts(load):
    return rounded(reversion.reversion_contexts(_points(load)).drop("context_sort_order"))


_CHRONOLOGICAL = f"date, {_ORDER}, time_bucket, group_key"
for _ranking, _by in (("chronological", ""), ("max_positive_reversion", "max_positive DESC, max_absolute DESC, "), ("max_absolute_reversion", "max_absolute DESC, max_positive DESC, "),
                      ("lowest_confidence", "low_count DESC, low_ratio DESC, max_positive DESC, max_absolute DESC, ")):
    @register(f"rank_contexts_{_ranking}", f"SELECT {_CONTEXT_COLUMNS} FROM {_CONTEXTS} c ORDER BY {_by}{_CHRONOLOGICAL} LIMIT 12", reversion=True)
    def rank_contexts(load, ranking=_ranking):
        return rounded(reversion.rank_contexts(reversion.reversion_contexts(_points(load)), ranking, 12).drop("context_sort_order"))


@register("rank_contexts_context_sort_order", f"""SELECT {_CONTEXT_COLUMNS}, CAST(10000 - {_ORDER} AS INT) AS context_sort_order FROM {_CONTEXTS} c
    ORDER BY context_sort_order, max_positive DESC, max_absolute DESC, {_CHRONOLOGICAL} LIMIT 12""", reversion=True)
def rank_contexts_context_sort_order(load):
    return rounded(reversion.rank_contexts(reversion.reversion_contexts(_points(load, True)), "context_sort_order", 12))


@register("reversion_curves", f"""SELECT date, time_bucket, group_key, venue, string_agg(horizon, ',' ORDER BY horizon_sort_order) AS horizons, round(sum(reversion_bps), 6) AS total
    FROM (SELECT date, time_bucket, rest AS group_key, venue, horizon, horizon_sort_order, reversion_bps FROM {_POINTS} p) q
    JOIN (SELECT date, time_bucket, group_key FROM {_CONTEXTS} c ORDER BY max_positive DESC, max_absolute DESC, {_CHRONOLOGICAL} LIMIT 12) s USING (date, time_bucket, group_key)
    GROUP BY date, time_bucket, group_key, venue""", reversion=True)
def reversion_curves(load):
    rows = reversion.reversion_curves(_points(load), n=12)
    return rounded(rows.select("date", "time_bucket", "group_key", "venue", F.array_join("horizons", ",").alias("horizons"), F.aggregate("values", F.lit(0.0), lambda t, v: t + v).alias("total")))


_H_PLACE, _V_PLACE = "coalesce(list_position(['30m', '1m'], horizon), 0)", "coalesce(list_position(['ODX', 'SBIJ'], venue), 0)"


@register("ordered_points", f"""SELECT date, time_bucket, rest AS group_key, horizon, venue, row_number() OVER (ORDER BY date, {_ORDER}, time_bucket, rest, CASE WHEN {_H_PLACE} > 0 THEN 0 ELSE 1 END,
    CASE WHEN {_H_PLACE} > 0 THEN {_H_PLACE} ELSE horizon_sort_order END, horizon, CASE WHEN {_V_PLACE} > 0 THEN {_V_PLACE} ELSE 99 END, venue) AS place FROM {_POINTS} p ORDER BY place LIMIT 200""", reversion=True)
def ordered_points(load):
    """The first points in an order of horizons and venues that is named in part."""
    rows = reversion.order_points(_points(load), ["ODX", "SBIJ"], ["30m", "1m"]).limit(200).select("date", "time_bucket", "group_key", "horizon", "venue")
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)  # 200 rows


@register("curve_summary", f"SELECT count(*) AS points, count(DISTINCT venue) AS venues, count(DISTINCT horizon) AS horizons, count(*) FILTER (reasons <> '') AS low_confidence FROM {_POINTS} p", reversion=True)
def curve_summary(load):
    return reversion.curve_summary(_points(load))


@register("reversion_diagnostics", f"""SELECT metric_name, status, round(delta, 6) AS delta, label FROM (SELECT metric_name, status, coalesce(change_abs, value - reference, 0) AS delta,
    concat_ws(', ', 'Horizon: ' || horizon, 'Sym: ' || sym, 'Venue: ' || venue, 'Date: ' || CAST(date AS VARCHAR), 'Intraday bucket: ' || {_B}) AS label FROM cmp) x
    ORDER BY CASE status WHEN 'alert' THEN 0 WHEN 'watch' THEN 1 ELSE 2 END, abs(delta) DESC, label LIMIT 12""", reversion=True)
def reversion_diagnostics(load):
    cmp = compare.compare_reversion_periods(base.reversion_obs(load), *base.in_periods(load))
    return rounded(reversion.reversion_diagnostics(cmp).select("metric_name", "status", "delta", "label"))


_HEADS = f"(SELECT *, row_number() OVER (ORDER BY reversion_bps DESC, horizon_sort_order, horizon, venue, rest, date, time_bucket) AS k FROM {_POINTS} p)"
_LOW = f"(SELECT *, row_number() OVER (ORDER BY horizon_sort_order, horizon, venue, rest, date, time_bucket) AS j FROM {_HEADS} h WHERE k > 3 AND reasons <> '')"
_FACT_COLUMNS = "venue, horizon, date, time_bucket, rest AS group_key"


@register("reversion_facts", f"""SELECT 'headline' AS kind, {_FACT_COLUMNS}, '+' || horizon || ' Reversion' AS metric_label, CASE WHEN reversion_bps >= 0 THEN '+' ELSE '' END || format('{{:.4f}} bps', reversion_bps) AS value_text,
    CASE WHEN reversion_bps >= 2 THEN 'alert' WHEN reversion_bps >= 0.5 THEN 'watch' ELSE 'normal' END AS status, CASE WHEN reversion_bps > 0 THEN 'positive' WHEN reversion_bps < 0 THEN 'negative' ELSE 'flat' END AS direction_word,
    CASE WHEN reasons <> '' THEN 'Low confidence: ' || reasons END AS caveat FROM {_HEADS} h WHERE k <= 3 UNION ALL
    SELECT 'low_confidence', {_FACT_COLUMNS}, '+' || horizon || ' Reversion sample size', 'low confidence', 'watch', 'low confidence', 'Low confidence: ' || reasons FROM {_LOW} l WHERE j <= 3""", reversion=True)
def reversion_facts(load):
    return reversion.reversion_facts(_points(load))


_CLOCK = "CAST({t} // 3600000 AS VARCHAR) || ':' || lpad(CAST(({t} // 60000) % 60 AS VARCHAR), 2, '0')"
_STEP = f"unnest(range({{a}}, {{b}}, {base.BUCKET_MS}))"


@register("bucket_grid", f"""SELECT g.label, g.sort_order, g.session, g.phase, count(t.seq) AS trades FROM (SELECT *, row_number() OVER (ORDER BY i, p, s) AS sort_order FROM (
    SELECT i, 1 AS p, s, session, 'continuous' AS phase, {_CLOCK.format(t='s')} || '-' || {_CLOCK.format(t='least(s + 1800000, b)')} AS label, CAST(NULL AS VARCHAR) AS code FROM (
        SELECT 0 AS i, 'AM' AS session, 41400000 AS b, {_STEP.format(a=32400000, b=41400000)} AS s UNION ALL SELECT 1, 'PM', 55740000, {_STEP.format(a=45000000, b=55740000)}) c UNION ALL
    SELECT * FROM (VALUES (0, 0, 32400000, 'AM', 'auction_open', 'AMO', 'AMO'), (0, 2, 41400000, 'AM', 'auction_close', 'AMC', 'AMC'),
        (1, 0, 45000000, 'PM', 'auction_open', 'PMO', 'PMO'), (1, 2, 55740000, 'PM', 'auction_close', 'PMC', 'PMC')) a) x) g
    LEFT JOIN trades t ON CASE WHEN g.code IS NULL THEN t.auction = 0 AND t.time_ms - t.time_ms % 1800000 = g.s ELSE upper(t.session) || CASE t.auction WHEN 1 THEN 'O' WHEN 2 THEN 'C' END = g.code END
    GROUP BY ALL""")
def bucket_grid(load):
    """Trades on the day's grid: clock buckets by their start, auctions by their label."""
    trades = load("trades")
    grid = calendar.bucket_grid(trades.sparkSession, [(32_400_000, 41_400_000), (45_000_000, 55_740_000)], "30m")
    code = F.concat(F.upper("session"), F.when(F.col("auction") == 1, "O").otherwise("C"))
    start = F.col("time_ms") - F.col("time_ms") % base.BUCKET_MS
    key = F.when(F.col("auction") == 0, start.cast("string")).otherwise(code)
    counts = trades.groupBy(key.alias("key")).agg(F.count("*").alias("trades"))
    grid = grid.withColumn("key", F.when(F.col("is_auction"), F.col("label")).otherwise(F.col("start_ms").cast("string")))
    return F.broadcast(grid).join(counts, "key", "left").select("label", "sort_order", "session", "phase", F.coalesce("trades", F.lit(0)).alias("trades"))


@register("calendar_weekdays", """SELECT CAST(d AS DATE) AS date, d IN (SELECT date FROM trades) AS traded FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-09', INTERVAL 1 DAY)) AS d) x
    WHERE isodow(d) <= 5""")
def calendar_weekdays(load):
    trades = load("trades")
    days = calendar.trading_days(trades, "2024-01-01", "2024-02-09").withColumn("t", F.lit(True))
    return calendar.weekdays_between(trades.sparkSession, "2024-01-01", "2024-02-09").join(days, "date", "left").select("date", F.coalesce("t", F.lit(False)).alias("traded"))


@register("trading_days", "SELECT DISTINCT date FROM trades WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def trading_days(load):
    return calendar.require_days(calendar.trading_days(load("trades"), "2024-01-10", "2024-01-20"), "2024-01-10", "2024-01-20")


@register("metric_definitions", f"""SELECT o.metric_name, o.n, d.label, d.unit, d.better AS higher_is_better, CASE WHEN metric_name IN ('turnover', 'volume', 'trade_count') THEN 'sum'
    WHEN metric_name = 'parkinson_volatility_bps' THEN 'mean' ELSE 'median' END AS default_aggregation FROM (SELECT metric_name, count(*) AS n FROM obs GROUP BY metric_name) o JOIN defs d USING (metric_name)""")
def metric_definitions(load):
    counts = base.observations(load).groupBy("metric_name").agg(F.count("*").alias("n"))
    return definitions.with_definitions(counts, "label", "unit", "higher_is_better", "default_aggregation")


def _fold(how: str, sql: str) -> None:
    @register(f"collapse_{how}", f"SELECT metric_name, group_key, date, round({sql}, 6) AS value FROM obs WHERE metric_name IN ('turnover', 'quoted_spread_bps') GROUP BY metric_name, group_key, date")
    def collapse(load):
        """One value per day of the buckets' values, which are in the order of their labels."""
        obs = base.observations(load).where(F.col("metric_name").isin("turnover", "quoted_spread_bps"))
        return rounded(observations.collapse_units(obs, ("metric_name", "group_key"), how, "time_bucket"))


_fold("first", "arg_min(value, time_bucket)")
_fold("last", "arg_max(value, time_bucket)")
_fold("median", "median(value)")
