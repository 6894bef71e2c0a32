"""Display labels and texts of buckets, groups, values and changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display names.
AUCTIONS = {"AMO": "AM opening auction", "AMC": "AM closing auction", "PMO": "PM opening auction", "PMC": "PM closing auction"}
GROUP_KEYS = {
    "date": "Date", "fixture": "Fixture", "group": "Group", "horizon": "Horizon", "market": "Market", "market_cap_bucket": "Market cap bucket",
    "topixCapGrp": "TOPIX cap group", "market_segment": "Market segment", "metric_name": "Metric",
    "reference_observation_aggregation": "Reference observation aggregation", "reference_observation_unit": "Reference observation unit",
    "sample_size": "Sample size", "sector": "Sector", "segment": "Segment", "source": "Source", "symbol": "Symbol",
    "time_bucket": "Intraday bucket", "venue": "Venue"}
CAP_VALUES = {"large": "Large cap", "mid": "Mid cap", "middle": "Mid cap", "small": "Small cap", "micro": "Micro cap"}
UNITS = {"date": "date", "group": "group", "symbol": "symbol", "time_bucket": "intraday bucket", "trading_day": "trading day", "venue": "venue"}
ACRONYMS = ("am", "bps", "id", "jpy", "llm", "odx", "pm", "q", "sbij", "tse")
CONTEXT_KEYS = ("market_cap_bucket", "segment", "sector", "venue", "horizon")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def finite(value: Column) -> Column:
    """True for a number that is not null, NaN or infinite."""
    value = value.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def settled(value: Column) -> Column:
    """A number to six digits, so that texts and orders do not see in which order its parts were added."""
    return F.round(value.cast("double"), 6)


def grouped(value: Column, digits: int) -> Column:
    """Digits in groups of three of the settled number, ties to the even digit."""
    return F.format_number(settled(value), digits)


def signed(value: Column, digits: int) -> Column:
    return F.concat(F.when(settled(value) >= 0, "+").otherwise(""), grouped(value, digits))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.replace(grouped(value * 100, digits), F.lit(","), F.lit("")), F.lit("%"))


def signed_percent(value: Column) -> Column:
    return F.concat(F.when(settled(value) >= 0, "+").otherwise(""), percent(value))


def _by_unit(value: Column, unit: Column, text) -> Column:
    plain = F.replace(text(value, 4), F.lit(","), F.lit(""))
    return (
        F.when(~finite(value), "not available").when(unit == "ratio", plain).when(unit == "count", text(value, 0))
        .when(unit == "JPY", F.concat(text(value, 0), F.lit(" JPY")))
        .when(F.coalesce(unit, F.lit("")) != "", F.concat(text(value, 4), F.lit(" "), unit)).otherwise(text(value, 4)))


def value_text(value: Column, unit: Column) -> Column:
    """A metric's value by unit; what is not finite is not available."""
    return _by_unit(value, unit, grouped)


def signed_value_text(value: Column, unit: Column) -> Column:
    return _by_unit(value, unit, signed)


def change_text(change: Column, share: Column, unit: Column) -> Column:
    """Absolute and relative change; null where both are."""
    parts = F.concat_ws(" ", F.when(change.isNotNull(), F.concat(F.lit("change "), signed_value_text(change, unit))), signed_percent(share))
    return F.nullif(parts, F.lit(""))


def card_text(value: Column, unit: Column) -> Column:
    """Short value of an overview card."""
    size = F.abs(value)

    def scaled(limit: float, suffix: str) -> Column:
        return F.concat(F.replace(grouped(value / limit, 1), F.lit(","), F.lit("")), F.lit(suffix))

    yen = F.when(size >= 1e12, scaled(1e12, "T JPY")).when(size >= 1e9, scaled(1e9, "B JPY")).when(size >= 1e6, scaled(1e6, "M JPY"))
    shares = F.when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K"))
    return (
        F.when(value.isNull(), "n/a").when(unit == "JPY", F.coalesce(yen, F.concat(grouped(value, 0), F.lit(" JPY"))))
        .when(unit == "shares", F.coalesce(shares, grouped(value, 0))).when(unit == "bps", scaled(1.0, " bps")).otherwise(value_text(value, unit)))


def delta_text(share: Column) -> Column:
    arrow = F.when(share > 0, "↑ ").otherwise("↓ ")
    return F.when(share.isNull(), "no comparison").when(share == 0, "0.0%").otherwise(F.concat(arrow, percent(F.abs(share))))


def delta_direction(share: Column) -> Column:
    return F.when(share.isNull() | (share == 0), "flat").when(share > 0, "up").otherwise("down")


def direction_word(share: Column, higher_is_better: Column) -> Column:
    """Word for a change; a metric without direction reads like one where lower is better."""
    better = F.coalesce(higher_is_better, F.lit(False))
    return (
        F.when(~finite(share), "changed").when(F.abs(share) < 0.01, "was flat")
        .when(share > 0, F.when(better, "increased").otherwise("rose")).otherwise(F.when(better, "decreased").otherwise("declined")))


def magnitude_text(share: Column, change: Column) -> Column:
    return F.when(finite(share), F.concat(F.lit(" "), percent(F.abs(share), 0))).when(
        finite(change), F.concat(F.lit(" "), signed(change, 0))).otherwise("")


def context_text(group: Column, bucket: Column) -> Column:
    """Cap group, classification, venue, horizon and auction of a comparison."""
    cap = F.coalesce(group["topixCapGrp"], group["topix_bucket"])
    auction = F.when(bucket.isin(*AUCTIONS), F.concat(bucket, F.lit(" auction")))
    return F.concat_ws(", ", cap, *[group[k] for k in CONTEXT_KEYS], auction)


def narrative(label: Column, interpretation: Column, share: Column, change: Column, higher: Column, group: Column, bucket: Column) -> Column:
    """One sentence on a change and the metric's interpretation."""
    context = F.nullif(context_text(group, bucket), F.lit(""))
    said = F.concat(label, F.lit(" "), direction_word(share, higher), magnitude_text(share, change),
                    F.coalesce(F.concat(F.lit(" in "), context), F.lit("")), F.lit("."))
    return F.concat_ws(" ", said, F.nullif(interpretation, F.lit("")))


def bucket_label(bucket: Column) -> Column:
    """Auction name, range with a dash, or the bucket itself; null for a blank one."""
    raw = F.trim(bucket)
    low, high = F.trim(F.regexp_extract(raw, r"^([^-]*)-(.*)$", 1)), F.trim(F.regexp_extract(raw, r"^([^-]*)-(.*)$", 2))
    ranged = F.when((low != "") & (high != ""), F.concat(low, F.lit("–"), high))
    return F.when(raw != "", F.coalesce(_lookup(AUCTIONS, F.upper(raw)), ranged, raw))


def group_key_label(key: Column) -> Column:
    words = F.transform(F.filter(F.split(F.trim(key), "_"), lambda w: w != ""), lambda w: F.when(
        F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000)))))
    return F.when(F.trim(key) == "", "Group").otherwise(F.coalesce(_lookup(GROUP_KEYS, F.trim(key)), F.array_join(words, " ")))


def unit_label(unit: Column) -> Column:
    """Name of an observation unit; another one reads like a group key in small letters, a blank one has none."""
    raw = F.nullif(F.trim(unit), F.lit(""))
    return F.when(raw.isNotNull(), F.coalesce(_lookup(UNITS, raw), F.lower(group_key_label(raw))))


def group_value_label(key: Column, value: Column) -> Column:
    cap = F.when(key == "market_cap_bucket", _lookup(CAP_VALUES, F.lower(F.trim(value))))
    return F.when(key == "time_bucket", F.coalesce(bucket_label(value), F.lit(""))).when(
        key == "reference_observation_unit", F.coalesce(unit_label(value), F.lit(""))).otherwise(F.coalesce(cap, F.trim(value)))


def group_label(group: Column) -> Column:
    """'Venue: TSE' for each key in order; null for an empty group."""
    items = F.transform(F.array_sort(F.map_entries(group)), lambda e: F.concat(
        group_key_label(e["key"]), F.lit(": "), group_value_label(e["key"], e["value"])))
    return F.nullif(F.array_join(items, ", "), F.lit(""))


def scope_label(date: Column, bucket: Column, group: Column) -> Column:
    """Date, bucket and group of a comparison in reading order; null where none is known."""
    day = F.concat(F.lit("Date: "), date.cast("string"))
    return F.nullif(F.concat_ws(", ", day, F.concat(F.lit("Intraday bucket: "), bucket_label(bucket)), group_label(group)), F.lit(""))


def caveats(n: Column, confidence: Column, z: Column, unit: Column) -> Column:
    """What limits a comparison, as an array of sentences."""
    size = F.when(n == 0, "No comparable reference observations were available.").when(
        n == 1, "One reference observation; z-score is intentionally omitted.").when(
        confidence.isin("insufficient", "weak"), F.concat(F.lit("Low confidence: "), n.cast("string"), F.lit(" reference observations; statistical scores are limited.")))
    no_score = F.when(z.isNull() & (n < 30), "No z-score shown because fewer than 30 comparable observations were available.")
    return F.array_distinct(F.array_compact(F.array(size, no_score, F.concat(F.lit("Reference observation unit: "), unit, F.lit(".")))))
