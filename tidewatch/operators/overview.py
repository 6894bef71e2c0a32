"""Overviews and selections of comparisons: counts, summaries, top changes, drilldowns, matrices and report tables.

Numbers that are null, NaN or infinite count as no size in orders and are left out of means. Ties are settled by names and
values, so that orders are total but for repeated rows, which stay. Rows without a group value are in no group table. Empty
comparisons give empty tables; an overview of one metric's rows needs its definition only for the label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.operators.compare import PRIORITY, priority, report_order, severity, size_of
from tidewatch.operators.definitions import family_of, metric_definitions, with_definitions
from tidewatch.operators.observations import DRILLDOWN_KEYS, SYMBOL_PAGE_KEYS, is_symbol_scoped, symbol_of


def where_status(cmp: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    return cmp.where(F.col("status").isin(*statuses))


def status_counts(cmp: DataFrame) -> DataFrame:
    return cmp.groupBy("metric_name", "status").agg(F.count("*").alias("n"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in PRIORITY]


def _worst() -> Column:
    """The worst status present."""
    out = F.lit("normal")
    for name, rank in reversed(PRIORITY.items()):
        out = F.when(F.min(priority()) == rank, name).otherwise(out)
    return out


def _mean(column: str) -> Column:
    return F.avg(F.when(labels.finite(F.col(column)), F.col(column)))


def _central(metric: Column, column: str) -> Column:
    """Mean of finite values, root mean square for volatilities."""
    x = F.when(labels.finite(F.col(column)), F.col(column))
    return F.when(metric.contains("volatility"), F.sqrt(F.avg(x * x))).otherwise(F.avg(x))


def metric_overview(cmp: DataFrame) -> DataFrame:
    """Per metric: overall status, counts, means and the scope of its most severe row."""
    order = F.struct(priority().alias("p"), (-size_of("z_score")).alias("z"), F.coalesce(F.col("date").cast("string"), F.lit("")).alias("d"),
                     F.coalesce("time_bucket", F.lit("")).alias("b"), F.col("group_key").alias("g"))
    scope = labels.scope_label(F.col("date"), F.col("time_bucket"), F.col("group"))
    return cmp.groupBy("metric_name").agg(
        _worst().alias("status"), F.count("*").alias("n"), *_counts(), *[_mean(c).alias(f"mean_{c}") for c in ("value", "reference_value", "change_abs", "change_pct")],
        F.min_by(scope, order).alias("most_severe_scope"))


def _overview_order() -> list[Column]:
    return [priority(), F.desc(F.col("alert_count") + F.col("watch_count")), F.lower("label"), F.col("metric_name")]


def family_overview(cmp: DataFrame) -> DataFrame:
    """Per metric family: overall status, counts, its metrics' labels in order and the leading metric."""
    names = with_definitions(metric_overview(cmp), "label").where(F.col("label").isNotNull())
    names = names.withColumn("family", family_of(F.col("metric_name"))).where("family <> metric_name")
    order = F.struct(priority().alias("p"), (-(F.col("alert_count") + F.col("watch_count"))).alias("a"), F.lower("label").alias("l"), F.col("metric_name").alias("m"))
    place = F.array_position(F.array(*[F.lit(r["metric_name"]) for r in metric_definitions(cmp.sparkSession).collect()]), F.col("metric_name"))
    return names.groupBy("family").agg(
        _worst().alias("status"), F.sum("n").alias("n"), *[F.sum(f"{s}_count").alias(f"{s}_count") for s in PRIORITY],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "label"))), lambda x: x["label"]), ", ").alias("metrics"),
        F.min_by("label", order).alias("leading_metric"))


def market_summary(cmp: DataFrame) -> DataFrame:
    """Buckets and repeated rows of each metric, date and group as one row; rows of single symbols are left out.

    Value and reference are central values, the change is recomputed from them, and scores and status are those of the
    most severe row (of equal ones, the first by bucket and value).
    """
    rows = cmp.where(~is_symbol_scoped(F.col("group")))
    order = F.struct(priority().alias("p"), (-size_of("z_score")).alias("z"), (-size_of("change_pct")).alias("c"), F.coalesce("time_bucket", F.lit("")).alias("b"), F.col("value").alias("v"))
    worst = F.struct("z_score", "percentile", "status", "comparison_confidence", "comparison_method", "higher_is_better")
    name = F.col("metric_name")
    out = rows.groupBy("metric_name", "date", "group_key").agg(
        F.first("group").alias("group"), _central(name, "value").alias("value"), _central(name, "reference_value").alias("reference_value"),
        F.min_by(worst, order).alias("w"), F.nullif(F.sum("reference_sample_size"), F.lit(0)).alias("reference_sample_size"))
    change = F.col("value") - F.col("reference_value")
    return out.select("metric_name", "date", F.lit(None).cast("string").alias("time_bucket"), "group", "group_key", "value", "reference_value", change.alias("change_abs"),
                      (change / F.nullif(F.col("reference_value"), F.lit(0.0))).alias("change_pct"), "w.*", "reference_sample_size")


def metric_level_summary(summary: DataFrame) -> DataFrame:
    """The most severe summary row of each metric."""
    rank = F.row_number().over(Window.partitionBy("metric_name").orderBy(*severity()))
    return summary.withColumn("rank", rank).where("rank = 1").drop("rank")


def _tail() -> Column:
    """The least finite adverse tail, 1 without one."""
    tails = [F.when(labels.finite(F.col(c)), F.col(c)) for c in ("normal_adverse_tail", "empirical_adverse_tail")]
    return F.coalesce(F.least(*tails), F.lit(1.0))


def _symbol_order() -> list[Column]:
    return [priority(), _tail(), F.desc(size_of("z_score")), F.desc(size_of("change_pct")), F.col("metric_name"),
            F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("time_bucket", F.lit("")), F.col("group_key")]


def symbol_anomalies(cmp: DataFrame, n: int = 20, include_normal: bool = False, keys: tuple[str, ...] = SYMBOL_PAGE_KEYS) -> DataFrame:
    """The worst comparison of each symbol, the n worst of them."""
    rows = cmp.withColumn("symbol", symbol_of(F.col("group"), keys)).where("symbol is not null")
    if not include_normal:
        rows = rows.where("status <> 'normal'")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(*_symbol_order()))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank").orderBy(*_symbol_order()).limit(n)


def symbol_series(obs: DataFrame, selected: DataFrame, keys: tuple[str, ...] = SYMBOL_PAGE_KEYS) -> DataFrame:
    """Observations of the selected symbols."""
    return obs.withColumn("symbol", symbol_of(F.col("group"), keys)).join(selected.select("symbol"), "symbol", "left_semi")


def symbol_detail_index(anomalies: DataFrame, details: DataFrame) -> DataFrame:
    """Selected symbols that have detail rows, with their status, metric and number of rows."""
    rows = details.groupBy("symbol").agg(F.count("*").alias("rows"))
    return anomalies.select("symbol", "status", "metric_name").join(rows, "symbol")


def top_changes(cmp: DataFrame, by: str = "metric", n: int = 5) -> DataFrame:
    """The n top alerts and watches above symbol level: first the worst of each metric (or family), then by severity."""
    if by not in ("metric", "family"):
        raise ValueError(f"unknown diversification: {by}")
    key = F.col("metric_name") if by == "metric" else family_of(F.col("metric_name"))
    rows = where_status(cmp.where(~is_symbol_scoped(F.col("group"))), ("alert", "watch")).withColumn("key", key)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*severity()))
    # a key can fill at most n places besides its first, so that each partition keeps its n + 1 best of a key before they are dealt
    return rows.withColumn("rank", rank).where(F.col("rank") <= n + 1).withColumn("again", F.col("rank") > 1).drop("rank").orderBy("again", *severity()).limit(n)


def driver_intensity(top: DataFrame) -> DataFrame:
    """Size of z of each top change as a whole percentage of the greatest, 8 at least; nothing where that is 0."""
    sizes = top.where(labels.finite(F.col("z_score"))).withColumn("size", F.abs("z_score"))
    return sizes.withColumn("most", F.max("size").over(Window.partitionBy(F.lit(0)))).where("most > 0").withColumn(  # at most n rows
        "intensity", F.greatest(F.lit(8), F.bround(F.col("size") / F.col("most") * 100).cast("int"))).drop("most")


def _filled(group: Column, keys: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.coalesce(F.trim(group[k]), F.lit("")) != "")


def drilldown_rows(cmp: DataFrame, keys: tuple[str, ...] = DRILLDOWN_KEYS, n: int | None = None, statuses: tuple[str, ...] = tuple(PRIORITY)) -> DataFrame:
    """Group-level comparisons by severity, then dimension, value, metric, date and bucket."""
    group = F.col("group")
    rows = where_status(cmp, statuses).where((F.size(_filled(group, keys)) > 0) & (F.size(_filled(group, SYMBOL_PAGE_KEYS)) == 0))
    rows = rows.withColumn("dimension", F.get(_filled(group, keys), F.lit(0))).withColumn("dimension_value", F.trim(group[F.col("dimension")]))
    rows = rows.withColumn("magnitude", F.greatest(size_of("z_score"), size_of("change_pct"), size_of("change_abs")))
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("dimension"))
    ordered = rows.orderBy(priority(), F.desc("magnitude"), place, "dimension_value", "metric_name", F.coalesce(F.col("date").cast("string"), F.lit("")),
                           F.coalesce("time_bucket", F.lit("")), "group_key", "value")
    return ordered if n is None else ordered.limit(n)


def primary_group(group: Column) -> Column:
    """The value that names a group best: a known dimension, else its first key that is no symbol, venue or horizon."""
    known = [group[k] for k in ("market_cap_bucket", "sector", "segment", "topixCapGrp", "market_segment")]
    others = F.filter(F.array_sort(F.map_entries(group)), lambda e: ~e["key"].isin("sym", "ric", "isin", "ticker", "venue", "horizon"))
    return F.nullif(F.coalesce(*known, F.get(others, F.lit(0))["value"]), F.lit(""))


MATRIX_METRICS = ("quoted_spread_bps", "top_of_book_depth")


def _grouped(cmp: DataFrame) -> DataFrame:
    return cmp.withColumn("group_value", primary_group(F.col("group"))).where("group_value is not null")


def group_metric_matrix(cmp: DataFrame, metrics: tuple[str, ...] = MATRIX_METRICS) -> DataFrame:
    """Mean change (percent) and z of each group and metric, the group's score and whether it is the default one.

    Nothing where there are fewer than two metrics or groups. Of equal scores the first group is the default.
    """
    rows = _grouped(cmp).where(F.col("metric_name").isin(*metrics))
    cells = rows.groupBy("group_value", "metric_name").agg((_mean("change_pct") * 100).alias("change"), _mean("z_score").alias("z"))
    scored = cells.withColumn("score", F.sum(F.abs(F.coalesce("change", F.lit(0.0)))).over(Window.partitionBy("group_value")))
    report = Window.partitionBy(F.lit(0))  # a few cells: groups times metrics
    top = scored.withColumn("top", F.max("score").over(report)).withColumns({
        "groups": F.size(F.collect_set("group_value").over(report)), "names": F.size(F.collect_set("metric_name").over(report)),
        "default_group": F.min(F.when(F.col("score") == F.col("top"), F.col("group_value"))).over(report)})
    return top.where("groups >= 2 and names >= 2").select(
        "group_value", "metric_name", "change", "z", "score", (F.col("group_value") == F.col("default_group")).alias("is_default"))


def group_daily_trend(cmp: DataFrame, metrics: tuple[str, ...] = MATRIX_METRICS) -> DataFrame:
    """Mean value of each group, metric and date; every date that any has, null where absent."""
    rows = _grouped(cmp).where(F.col("metric_name").isin(*metrics) & F.col("value").isNotNull())
    means = rows.groupBy("group_value", "metric_name", "date").agg(F.avg("value").alias("value"))
    series = means.groupBy("group_value", "metric_name").agg(F.collect_list(F.struct("date", "value")).alias("points"))  # days of one report
    every = F.array_distinct(F.flatten(F.collect_list("points.date").over(Window.partitionBy(F.lit(0)))))  # a few series
    grid = series.withColumn("days", every).select("group_value", "metric_name", "points", F.explode("days").alias("date"))
    held = F.filter("points", lambda p: p["date"].eqNullSafe(F.col("date")))
    return grid.select("group_value", "metric_name", "date", F.get(held, F.lit(0))["value"].alias("value"))


def group_heatmap(cmp: DataFrame, n: int = 10) -> DataFrame:
    """Per metric the row of greatest relative change of each group, the n greatest groups; metrics of two groups or more.

    The greatest change of a group is that of the greatest unrounded size, so that a rise and a fall that agree to six digits are
    told apart; of equal sizes it is that of the first row in the order of the drilldowns, as far as cmp has its columns. Rows
    without a finite change come last.
    """
    rows = with_definitions(_grouped(cmp), "label").where("label is not null")
    change = F.when(labels.finite(F.col("change_pct")), F.col("change_pct"))
    sizes = [size_of(c) for c in ("z_score", "change_pct", "change_abs") if c in cmp.columns]
    ties = {"status": priority(), "change_pct": -F.greatest(F.lit(0.0), *sizes), "date": F.coalesce(F.col("date").cast("string"), F.lit("")),
            "time_bucket": F.coalesce("time_bucket", F.lit("")), "group_key": F.col("group_key"), "value": F.col("value")}
    order = F.struct(F.coalesce(-F.abs(change), F.lit(0.0)).alias("size"), change.isNull().alias("none"), *[k.alias(f"by_{c}") for c, k in ties.items() if c in cmp.columns])
    best = F.min_by(F.struct("change_pct"), order)["change_pct"]
    cells = rows.groupBy("metric_name", "label", "group_value").agg(best.alias("change_pct"))
    by = Window.partitionBy("metric_name")
    ranked = cells.withColumn("rank", F.row_number().over(by.orderBy(F.desc(size_of("change_pct")), "group_value"))).withColumn("groups", F.count("*").over(by))
    return ranked.where((F.col("rank") <= n) & (F.col("groups") >= 2)).drop("groups")


def delta_bars(cmp: DataFrame, n: int = 8) -> DataFrame:
    """The n greatest relative changes with bars as whole percentages of the greatest; nothing where that is 0."""
    top = cmp.orderBy(F.desc(size_of("change_pct")), *severity()).limit(n)
    return top.withColumn("most", F.max(size_of("change_pct")).over(Window.partitionBy(F.lit(0)))).where("most > 0").withColumn(  # at most n rows
        "width", F.bround(size_of("change_pct") / F.col("most") * 100).cast("int")).drop("most")


def signal_callout(summary: DataFrame, metric: str = "quoted_spread_bps") -> DataFrame:
    """Alerts, watches, rows and mean change of one metric, and the sentence on them."""
    out = with_definitions(summary.where(F.col("metric_name") == metric), "label").groupBy("label").agg(
        F.count_if(F.col("status") == "alert").alias("alerts"), F.count_if(F.col("status") == "watch").alias("watches"), F.count("*").alias("n"),
        F.avg("change_pct").alias("change"))
    direction = F.when(F.coalesce("change", F.lit(0.0)) >= 0, "up").otherwise("down")
    size = F.coalesce(labels.percent(F.abs("change")), F.lit("n/a"))
    text = F.format_string("%s is %s %s versus reference. Status mix: %d alerts, %d watch rows across %d market contexts.",
                           "label", direction, size, "alerts", "watches", "n")
    return out.select("alerts", "watches", "n", "change", text.alias("comment"))


KPI_METRICS = ("turnover", "quoted_spread_bps", "top_of_book_depth", "primary_quote_reversion_100ms_bps")


def _texts(rows: DataFrame) -> list[Column]:
    """Text columns of a report row."""
    unit = F.coalesce("unit", F.lit(""))
    return [
        labels.value_text(F.col("value"), unit).alias("value_text"),
        F.when(F.col("reference_value").isNotNull(), labels.value_text(F.col("reference_value"), unit)).alias("reference_text"),
        labels.change_text(F.col("change_abs"), F.col("change_pct"), unit).alias("change_text"), F.col("status"),
        labels.scope_label(F.col("date"), F.col("time_bucket"), F.col("group")).alias("scope")]


def _named(cmp: DataFrame) -> DataFrame:
    return with_definitions(cmp.drop("label", "unit"), "label", "unit").withColumn("label", F.coalesce("label", "metric_name"))


def comparison_table(cmp: DataFrame, n: int | None = None) -> DataFrame:
    """Report rows in report order: label, value, reference, change, status and scope as texts."""
    rows = _named(cmp).orderBy(*report_order())
    rows = rows if n is None else rows.limit(n)
    return rows.select("metric_name", "label", *_texts(rows))


def drilldown_table(cmp: DataFrame, n: int | None = 25, keys: tuple[str, ...] = DRILLDOWN_KEYS) -> DataFrame:
    """Group-level report rows as texts, in the order of the drilldowns, with dimension and value as labels."""
    rows = _named(drilldown_rows(cmp, keys, n))
    return rows.select(
        "metric_name", "label", labels.group_key_label(F.col("dimension")).alias("dimension"), labels.group_value_label(F.col("dimension"), F.col("dimension_value")).alias("dimension_value"),
        *_texts(rows))


def symbol_table(cmp: DataFrame, symbols: DataFrame, n: int | None = 25, keys: tuple[str, ...] = SYMBOL_PAGE_KEYS) -> DataFrame:
    """Report rows of each of the given symbols (column symbol) as texts, the first n of each in report order.

    A join with the chosen symbols, then a rank that each partition prunes to its n best rows of a symbol.
    """
    rows = _named(cmp.withColumn("symbol", symbol_of(F.col("group"), keys)).join(symbols.select("symbol").distinct(), "symbol", "left_semi"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(*report_order()))
    rows = rows.withColumn("place", place)
    rows = rows if n is None else rows.where(F.col("place") <= n)
    return rows.select("symbol", "place", "metric_name", "label", *_texts(rows))


def kpi_snapshot(summary: DataFrame, metrics: tuple[str, ...] = KPI_METRICS) -> DataFrame:
    """Report rows of the chosen metrics in their order."""
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric_name"))
    return comparison_table(summary.where(F.col("metric_name").isin(*metrics))).withColumn("place", place).orderBy("place")


def executive_overview(cmp: DataFrame, by: str = "metric") -> dict[str, DataFrame]:
    """The overview's tables: top changes, their drivers, status counts, metrics and families."""
    top = top_changes(cmp, by)
    return {"top_changes": top, "drivers": driver_intensity(top), "status_counts": status_counts(cmp), "metrics": metric_overview(cmp), "families": family_overview(cmp)}
