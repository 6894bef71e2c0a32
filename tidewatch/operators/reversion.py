"""Reversion curves: points, confidence, contexts, diagnostics and facts.

A point without venue, horizon or value fails the query; one without trade count or notional is of low confidence. Ties are
settled by date, bucket in market order, group, horizon and venue. Repeated points stay. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.functions.scalars import bucket_order, duration_of
from tidewatch.operators.definitions import is_reversion
from tidewatch.operators.observations import group_key

#: Sample sizes below which a point is of low confidence, and bounds of watch and alert in basis points.
MIN_TRADES, MIN_NOTIONAL, WATCH_BPS, ALERT_BPS = 100, 100_000_000.0, 0.5, 2.0
RANKINGS = ("chronological", "max_positive_reversion", "max_absolute_reversion", "lowest_confidence", "context_sort_order")


def curve_points(obs: DataFrame) -> DataFrame:
    """One point per observation; one without venue, horizon or value, or with bad metadata, fails the query."""
    group, meta = F.col("group"), F.col("metadata")

    def required(value: Column, what: str) -> Column:
        return F.coalesce(value, F.raise_error(F.concat(F.lit(f"reversion point lacks {what}: "), F.col("metric_name"))))

    rest = F.map_filter(group, lambda k, _: ~k.isin("venue", "horizon"))
    return obs.select(
        required(F.nullif(group["venue"], F.lit("")), "venue").alias("venue"), required(F.nullif(group["horizon"], F.lit("")), "horizon").alias("horizon"),
        required(F.col("value").cast("string"), "value").cast("double").alias("reversion_bps"), "date", "time_bucket", rest.alias("group"),
        group_key(rest).alias("group_key"), meta["trade_count"].cast("long").alias("trade_count"), meta["notional"].cast("double").alias("notional"),
        meta["horizon_sort_order"].cast("int").alias("horizon_sort_order"), meta["context_sort_order"].cast("int").alias("context_sort_order"),
        meta["low_confidence"].cast("boolean").alias("low_confidence"))


def _number(value: Column) -> Column:
    """Text of a number, whole where it is within a millionth of a whole one."""
    value = F.round(value, 6)
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def flag_confidence(points: DataFrame, min_trades: int = MIN_TRADES, min_notional: float = MIN_NOTIONAL) -> DataFrame:
    """points with the reasons for low confidence; an upstream mark stays."""
    n, notional = F.col("trade_count"), F.col("notional")
    few = F.when(n.isNull(), "missing trade_count").when(n < min_trades, F.concat(F.lit("trade_count "), n.cast("string"), F.lit(f" < {min_trades}")))
    small = F.when(notional.isNull(), "missing notional").when(
        notional < min_notional, F.concat(F.lit("notional "), _number(notional), F.lit(" < "), _number(F.lit(float(min_notional)))))
    reasons = F.array_compact(F.array(few, small))
    return points.withColumn("confidence_reasons", reasons).withColumn(
        "low_confidence", F.coalesce("low_confidence", F.lit(False)) | (F.size(reasons) > 0))


def horizon_key(order: list[str] | None = None) -> list[Column]:
    """Sort key of a horizon: its place in order, else its stored order, else its duration, else its text."""
    place = F.array_position(F.array(*[F.lit(h) for h in order]), F.col("horizon")) if order else F.lit(0)
    ms = duration_of(F.col("horizon"))
    kind = F.when(place > 0, 0).when(F.col("horizon_sort_order").isNotNull(), 1).when(ms.isNotNull(), 2).otherwise(3)
    return [kind, F.when(place > 0, place).otherwise(F.coalesce("horizon_sort_order", ms, F.lit(0))), F.col("horizon")]


def venue_key(order: list[str] | None = None) -> list[Column]:
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("venue")) if order else F.lit(0)
    return [F.when(place > 0, place).otherwise(2**31 - 1), F.col("venue")]


def _chronological() -> list[Column]:
    return [F.asc_nulls_first("date"), bucket_order(F.col("time_bucket")), F.coalesce("time_bucket", F.lit("")), F.col("group_key")]


def order_points(points: DataFrame, venues: list[str] | None = None, horizons: list[str] | None = None) -> DataFrame:
    """Points by date, bucket, group, horizon and venue."""
    return points.orderBy(*_chronological(), *horizon_key(horizons), *venue_key(venues))


def reversion_status(value: Column, watch: float = WATCH_BPS, alert: float = ALERT_BPS) -> Column:
    return F.when(value >= alert, "alert").when(value >= watch, "watch").otherwise("normal")


CONTEXT = ("date", "time_bucket", "group_key")


def reversion_contexts(points: DataFrame, *more: Column) -> DataFrame:
    """Per date, bucket and group: greatest positive and absolute reversion, low-confidence count and share, least order; more aggregates on request."""
    low = F.coalesce("low_confidence", F.lit(False))
    return points.groupBy(*CONTEXT).agg(
        F.max(F.greatest("reversion_bps", F.lit(0.0))).alias("max_positive"), F.max(F.abs("reversion_bps")).alias("max_absolute"),
        F.count_if(low).alias("low_count"), F.avg(low.cast("double")).alias("low_ratio"), F.min("context_sort_order").alias("context_sort_order"), *more)


def rank_contexts(contexts: DataFrame, ranking: str = "max_positive_reversion", n: int | None = None) -> DataFrame:
    """Contexts by one of RANKINGS, the first n."""
    positive, absolute = F.desc("max_positive"), F.desc("max_absolute")
    orders = {
        "chronological": [], "max_positive_reversion": [positive, absolute], "max_absolute_reversion": [absolute, positive],
        "lowest_confidence": [F.desc("low_count"), F.desc("low_ratio"), positive, absolute],
        "context_sort_order": [F.asc_nulls_last("context_sort_order"), positive, absolute]}
    if ranking not in orders:
        raise ValueError(f"ranking must be one of: {', '.join(RANKINGS)}")
    rows = contexts.orderBy(*orders[ranking], *_chronological())
    return rows if n is None else rows.limit(n)


def reversion_curves(points: DataFrame, ranking: str = "max_positive_reversion", n: int | None = None) -> DataFrame:
    """One trace per chosen context and venue: its points in horizon order (as many as there are horizons)."""
    kind, rank, text = horizon_key()
    point = F.struct("venue", kind.alias("k"), rank.alias("r"), text.alias("horizon"), "reversion_bps")
    # a context carries its points, which are no more than venues times horizons, so that points are made once
    chosen = rank_contexts(reversion_contexts(points, F.collect_list(point).alias("p")), ranking, n).select(*CONTEXT, F.inline("p"))
    traces = chosen.groupBy(*CONTEXT, "venue").agg(F.array_sort(F.collect_list(F.struct("k", "r", "horizon", "reversion_bps"))).alias("p"))
    return traces.select(*CONTEXT, "venue", F.transform("p", lambda x: x["horizon"]).alias("horizons"), F.transform("p", lambda x: x["reversion_bps"]).alias("values"))


def curve_summary(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("points"), F.count_distinct("venue").alias("venues"), F.count_distinct("horizon").alias("horizons"),
                      F.count_if("low_confidence").alias("low_confidence"))


def reversion_diagnostics(cmp: DataFrame, n: int | None = 12) -> DataFrame:
    """Reversion comparisons by severity and size of the difference from the reference, with a label."""
    delta = F.coalesce("change_abs", F.col("value") - F.col("reference_value"), F.lit(0.0))
    scope = labels.scope_label(F.col("date"), F.col("time_bucket"), F.create_map().cast("map<string,string>"))
    rows = cmp.where(is_reversion(F.col("metric_name"))).withColumn("delta", delta).where(labels.finite(F.col("delta")))
    rows = rows.withColumn("label", F.concat_ws(", ", labels.group_label(F.col("group")), scope))
    rank = F.when(F.col("status") == "alert", 0).when(F.col("status") == "watch", 1).otherwise(2)
    rows = rows.orderBy(rank, F.desc(F.abs("delta")), "label")
    return rows if n is None else rows.limit(n)


def headline_points(points: DataFrame, n: int = 3, m: int = 3) -> DataFrame:
    """The n points of greatest reversion, then m of low confidence that are not among them, told apart by kind.

    The n points come to the driver, so that points are made twice, not three times.
    """
    identity = ["date", "time_bucket", "venue", "horizon", "group_key"]
    key = [*horizon_key(), *venue_key(), F.col("group_key"), F.asc_nulls_first("date"), F.asc_nulls_first("time_bucket")]
    found = points.orderBy(F.desc("reversion_bps"), *key).limit(n)
    top = points.sparkSession.createDataFrame(found.collect(), found.schema)
    heads = top.select(*[F.col(c).alias(f"h_{c}") for c in identity])
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"h_{c}"))
    low = points.where("low_confidence").join(F.broadcast(heads), same, "left_anti").orderBy(*key).limit(m)  # n rows
    return top.withColumn("kind", F.lit("headline")).unionByName(low.withColumn("kind", F.lit("low_confidence")))


def reversion_facts(points: DataFrame, n: int = 3, m: int = 3, watch: float = WATCH_BPS, alert: float = ALERT_BPS) -> DataFrame:
    """Facts on the headline points and on those of low confidence: label, group, value text, status, word and caveat."""
    if n < 0 or m < 0 or watch < 0 or alert < watch:
        raise ValueError("counts and the watch bound must not be negative, nor the alert bound below it")
    head, value = F.col("kind") == "headline", F.col("reversion_bps")
    name = F.concat(F.when(F.col("horizon").startswith("+"), "").otherwise("+"), "horizon", F.lit(" Reversion"))
    word = F.when(value > 0, "positive").when(value < 0, "negative").otherwise("flat")
    reasons = F.when(F.size("confidence_reasons") > 0, F.array_join("confidence_reasons", "; ")).otherwise("sample-size thresholds were not met")
    text = F.concat(F.replace(labels.signed(value, 4), F.lit(","), F.lit("")), F.lit(" bps"))
    return headline_points(points, n, m).select(
        "kind", "venue", "horizon", "date", "time_bucket", "group_key", F.when(head, name).otherwise(F.concat(name, F.lit(" sample size"))).alias("metric_label"),
        F.when(head, text).otherwise("low confidence").alias("value_text"), F.when(head, reversion_status(value, watch, alert)).otherwise("watch").alias("status"),
        F.when(head, word).otherwise("low confidence").alias("direction_word"),
        F.when(F.col("low_confidence"), F.concat(F.lit("Low confidence: "), reasons)).alias("caveat"))
