"""Operators on hand-written rows: published numbers, nulls, ties, repeated rows, empty tables and clashing names."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels, scalars
from tidewatch.operators import asof, commentary, compare, definitions, facts, observations, overview, ranks, reversion, trends
from tidewatch.sources import calendar, ticks

DAY = dt.date(2024, 3, 1)
OBS = "metric_name string, date date, time_bucket string, `group` map<string,string>, value double, metadata map<string,string>"


def obs(spark, rows):
    """rows of (metric, day number, bucket, group, value[, metadata])"""
    full = [(m, DAY + dt.timedelta(days=d), b, g, v, *(rest or [{}])) for m, d, b, g, v, *rest in rows]
    return spark.createDataFrame(full, OBS).withColumn("group_key", observations.group_key(F.col("group")))


def history(spark, metric, values, group=None, bucket="09:00"):
    return obs(spark, [(metric, -1 - i, bucket, group or {}, float(v)) for i, v in enumerate(values)])


def one(spark, metric, value, values, **options):
    return compare.compare(obs(spark, [(metric, 0, "09:00", {}, value)]), history(spark, metric, values), **options).first()


def test_scores_of_small_samples(spark, monkeypatch):
    monkeypatch.setattr(compare, "MIN_NORMAL", 3)
    assert one(spark, "x", 13.0, [10, 11, 12], robust=False)["z_score"] == pytest.approx(2.0)
    assert one(spark, "x", 13.0, [10, 11, 12])["z_score"] == pytest.approx(2 / 1.4826)


def test_statuses(spark):
    row = one(spark, "x", 13.0, [10])
    assert (row["change_abs"], row["status"], row["z_score"]) == (3.0, "comparison_only", None) and row["message"].startswith("comparison only: one")
    row = one(spark, "quoted_spread_bps", 19.0, range(1, 21))
    assert row["empirical_percentile"] == pytest.approx(0.95) and row["empirical_adverse_tail"] == pytest.approx(0.10) and row["z_score"] is None
    assert row["comparison_confidence"] == "weak" and row["status"] == "watch"
    for metric, value in (("quoted_spread_bps", 29.0), ("top_of_book_depth", 2.0)):
        assert one(spark, metric, value, range(1, 31))["empirical_adverse_tail"] < 0.10
    neutral = [10.0 + i % 5 for i in range(30)]
    row = one(spark, "turnover", 14.0, neutral)
    cdf = 0.5 * math.erfc(-row["z_score"] / math.sqrt(2))
    assert row["higher_is_better"] is None and row["normal_adverse_tail"] == pytest.approx(2 * (1 - cdf)) and row["empirical_adverse_tail"] == pytest.approx(12 / 30)
    low = one(spark, "turnover", 8.0, neutral)
    assert low["normal_adverse_tail"] < 0.10 and low["status"] in ("alert", "watch")  # a fall counts as much as a surge
    assert one(spark, "turnover", 11.0, [10] * 12)["range_position_score"] is None and one(spark, "turnover", 12.0, [10, 14])["range_position_score"] == pytest.approx(50.0)


def test_compare_folds_days_and_keeps_nulls(spark):
    reference = obs(spark, [("m", -1, None, {"a": "1", "b": "2"}, 10.0), ("m", -1, None, {"b": "2", "a": "1"}, 14.0), ("m", -2, None, {"a": "1", "b": "2"}, 30.0), ("m", -3, None, {"a": "1", "b": "2"}, None)])
    current = obs(spark, [("m", 0, None, {"b": "2", "a": "1"}, 20.0), ("m", 0, None, {"a": "1", "b": "2"}, None), ("m", 0, "x", {}, 1.0), ("m", 0, "x", {}, 1.0)])
    rows = compare.compare(current, reference).collect()
    assert len(rows) == 4
    found = [r for r in rows if r["value"] == 20.0][0]
    assert (found["reference_sample_size"], found["reference_value"]) == (2, 21.0)
    assert [r["status"] for r in rows if r["value"] == 1.0] == ["comparison_only"] * 2 and {r["reference_sample_size"] for r in rows if r["value"] == 1.0} == {0}
    assert compare.compare(current.limit(0), reference).count() == 0 and compare.compare(current, reference.limit(0)).count() == 4
    with pytest.raises(ValueError):
        observations.collapse_units(reference, compare.KEYS, "mode")
    firsts = {h: observations.collapse_units(reference, ("metric_name",), h, "value").orderBy("date").first()["value"] for h in ("first", "last", "sum", "median")}
    assert firsts == {"first": 30.0, "last": 30.0, "sum": 30.0, "median": 30.0}


def test_reversion_comparison_is_strict(spark):
    name = "primary_quote_reversion_1s_bps"
    good = obs(spark, [(name, d, "b", {"venue": v, "horizon": "1s"}, 1.0 + d * d) for d in range(0, -12, -1) for v in ("A", "B")])
    rows = compare.compare_reversion(good.where(F.col("date") == F.lit(DAY)), good.where(F.col("date") < F.lit(DAY))).collect()
    assert [r["reference_sample_size"] for r in rows] == [11, 11] and all(r["higher_is_better"] is False for r in rows)
    for bad in [("turnover", 0, "b", {"venue": "A", "horizon": "1s"}, 1.0), (name, 0, "b", {"venue": "A"}, 1.0)]:
        with pytest.raises(Exception, match="no reversion observation|lacks a comparable key"):
            compare.compare_reversion(obs(spark, [bad]), good).collect()
    with pytest.raises(Exception, match="lacks a comparable key"):
        compare.compare(obs(spark, [("m", 0, "b", {}, 1.0)]), obs(spark, [("m", -1, "b", {}, 1.0)]), ("metric_name", "sector")).collect()


def test_market_summary_and_selection(spark):
    reference = [("quoted_spread_bps", -1 - i, b, g, 10.0 + i % 5) for i in range(35) for b in ("09:00", "10:00") for g in ({"topixCapGrp": "Large"}, {"sym": "S1"}, {"venue": "V"})]
    current = [("quoted_spread_bps", 0, "09:00", {"topixCapGrp": "Large"}, 30.0), ("quoted_spread_bps", 0, "10:00", {"topixCapGrp": "Large"}, 12.0),
               ("quoted_spread_bps", 0, "09:00", {"sym": "S1"}, 30.0), ("quoted_spread_bps", 0, "09:00", {"venue": "V"}, 31.0), ("my_volatility", 0, "09:00", {"venue": "V"}, 3.0), ("my_volatility", 0, "10:00", {"venue": "V"}, 4.0)]
    cmp = compare.compare(obs(spark, current), obs(spark, reference))
    rows = {(r["metric_name"], r["group_key"]): r for r in overview.market_summary(cmp).collect()}
    assert set(rows) == {("quoted_spread_bps", '{"topixCapGrp":"Large"}'), ("quoted_spread_bps", '{"venue":"V"}'), ("my_volatility", '{"venue":"V"}')}
    large = rows["quoted_spread_bps", '{"topixCapGrp":"Large"}']
    assert (large["value"], large["status"], large["reference_sample_size"]) == (21.0, "alert", 70) and large["z_score"] == pytest.approx((30 - 12) / 1.4826)
    assert rows["my_volatility", '{"venue":"V"}']["value"] == pytest.approx(math.sqrt(12.5)) and rows["my_volatility", '{"venue":"V"}']["reference_sample_size"] is None
    assert [r["symbol"] for r in overview.symbol_anomalies(cmp).collect()] == ["S1"]
    top = overview.top_changes(cmp)
    assert [r["group_key"] for r in top.collect()] == ['{"venue":"V"}', '{"topixCapGrp":"Large"}']
    assert [r["intensity"] for r in overview.driver_intensity(top).orderBy(F.desc("intensity")).collect()] == [100, 95]
    drilled = overview.drilldown_rows(cmp).collect()
    assert [(r["dimension_value"], r["status"]) for r in drilled] == [("Large", "alert"), ("Large", "normal")]
    assert overview.group_metric_matrix(cmp).count() == 0 and overview.top_changes(cmp.limit(0)).count() == 0
    assert definitions.undefined_metrics(cmp).collect()[0]["metric_name"] == "my_volatility"
    assert overview.metric_level_summary(overview.market_summary(cmp)).count() == 2
    names = {n: t.count() for n, t in overview.executive_overview(cmp).items()}
    assert names["families"] == 1 and names["metrics"] == 2


def test_trend_rollups(spark):
    rows = [("turnover", 0, "a", {}, 10.0), ("turnover", 0, "b", {}, 5.0), ("turnover", 1, "a", {}, 8.0), ("quoted_spread_bps", 0, "a", {}, 5.0), ("quoted_spread_bps", 0, "b", {}, 7.0),
            ("quoted_spread_bps", 1, "a", {}, 9.0), ("x_volatility", 3, "a", {}, 3.0), ("x_volatility", 4, "a", {}, 4.0), ("turnover", 1, "c", {}, None), ("turnover", 1, "d", {}, float("inf"))]
    daily = {(r["metric_name"], r["date"].day): r["value"] for r in trends.daily_rollup(obs(spark, rows)).collect()}
    assert [daily["turnover", d] for d in (1, 2)] == [15.0, 8.0] and [daily["quoted_spread_bps", d] for d in (1, 2)] == [6.0, 9.0]
    weekly = {r["metric_name"]: r["value"] for r in trends.trend_series(obs(spark, rows), "weekly").collect()}
    assert weekly["x_volatility"] == pytest.approx(math.sqrt(12.5))


def test_kendall_and_classes(spark):
    for n in (2, 3, 4, 5):
        found = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        for d in range(n * (n - 1) // 2 + 1):
            far = abs(d - n * (n - 1) / 4)
            assert ranks.exact_tail(n, d) == pytest.approx(sum(abs(f - n * (n - 1) / 4) >= far for f in found) / len(found))
    days = [DAY + dt.timedelta(days=i) for i in range(9)]

    def classified(values, exact=True):
        frame = spark.createDataFrame([("m", d, float(v)) for d, v in zip(days, values)], "metric_name string, date date, value double")
        return trends.classify_trend(frame, exact).first()

    assert classified([1, 2, 3, 4])["label"] == "insufficient" and classified(range(10, 19))["label"] == "strong_up_trend"
    assert classified([9, 8, 7, 6, 5, 4, 3, 2, 1])["label"] == "strong_down_trend" and classified([5, 4, 5, 4, 5, 4, 5, 4, 5])["label"] == "fluctuating"
    assert classified([100 + 0.5 * i for i in range(9)])["label"] == "mild_up_trend" and classified([7] * 9)["tau"] == 0.0
    assert classified(range(10, 19))["p_value"] == pytest.approx(2 / math.factorial(9)) and "strong up trend" in classified(range(10, 19))["summary_text"]
    zero = spark.createDataFrame([("m", days[0], 0.0), ("m", days[1], 5.0)], "metric_name string, date date, value double")
    assert [r["value"] for r in trends.rebase(zero).orderBy("date").collect()] == [0.0, 5.0]


def test_activity_distribution(spark):
    def rows(values):
        return obs(spark, [("turnover", d, b, {}, v) for d, b, v in values])

    reference = rows([(0, "09:00", 100.0), (0, "10:00", 300.0), (1, "09:00", 200.0), (1, "10:00", 200.0), (1, "10:00", None), (0, "10:00", float("nan")), (0, "09:00", -5.0)])
    found = trends.activity_distribution(rows([(5, "09:00", 150.0), (5, "10:00", 450.0)]), reference).orderBy("bucket_order").collect()
    assert [(r["q1"], r["median"], r["q3"], r["current"]) for r in found] == [(31.25, 37.5, 43.75, 25.0), (100.0, 100.0, 100.0, 100.0)]
    labels_ = ["PMC", "15:00", "AMO", "09:00", "PMO", "AMC", "12:30", "Full day"]
    frame = spark.createDataFrame([(x,) for x in labels_], "b string")
    assert [r["b"] for r in frame.orderBy(scalars.bucket_order(F.col("b"))).collect()] == ["AMO", "09:00", "AMC", "PMO", "12:30", "15:00", "PMC", "Full day"]
    assert [r["b"] for r in frame.orderBy(scalars.bucket_order(F.col("b"), legacy=True)).collect()] == ["AMO", "AMC", "PMO", "PMC", "09:00", "12:30", "Full day", "15:00"]
    shares = {r["session"]: r["share"] for r in trends.session_share(rows([(0, "AMO", 1.0), (0, "12:30", 3.0), (1, "09:00", 2.0)])).collect()}
    assert len(shares) == 7 and shares["AM opening auction"] == 12.5 and shares["PM continuous session"] == 37.5 and shares["AM continuous session"] == 50.0
    assert trends.activity_distribution(reference.limit(0), reference.limit(0)).count() == 0


def test_cards_and_bars(spark):
    current = obs(spark, [("turnover", 0, "a", {}, 2e9), ("turnover", 1, "a", {}, 4e9), ("z_volatility", 0, "a", {}, 3.0), ("z_volatility", 0, "b", {}, 4.0), ("volatility", 0, "a", {}, 7.0)])
    reference = obs(spark, [("turnover", -1, "a", {}, 2e9)])
    cards = {r["card"]: r for r in trends.overview_cards(current, reference).collect()}
    assert cards["Traded Value"]["value_text"] == "3.0B JPY" and cards["Traded Value"]["delta_text"] == "↑ 50.0%" and cards["Volatility"]["metric_name"] == "volatility"
    assert cards["Volatility"]["delta_text"] == "no comparison"
    bars = trends.spark_bars(current.where("metric_name = 'turnover'"), reference).orderBy("label").collect()
    assert [r["height"] for r in bars] == [28.0, 96.0] and bars[0]["mean_height"] == 28.0
    long = obs(spark, [("turnover", d, "a", {}, float(d)) for d in range(40)])
    assert all("-W" in r["label"] for r in trends.spark_bars(long, reference).collect())


def test_reversion_points(spark):
    name = "primary_quote_reversion_{}_bps"
    rows = [(name.format(h), 0, "b", {"venue": v, "horizon": h, "sym": "S"}, x, m) for h, v, x, m in [
        ("1s", "B", 2.5, {"trade_count": "200", "notional": "2e8"}), ("500ms", "A", -3.0, {"trade_count": "5", "notional": "2e8"}), ("10s", "A", 0.6, {"notional": "10.5"}),
        ("1s", "A", 0.0, {"trade_count": "200", "notional": "2e8", "low_confidence": "true", "context_sort_order": "3"})]]
    points = reversion.flag_confidence(reversion.curve_points(obs(spark, rows)))
    flags = {(r["horizon"], r["venue"]): r["confidence_reasons"] for r in points.collect()}
    assert flags == {("1s", "B"): [], ("500ms", "A"): ["trade_count 5 < 100"], ("10s", "A"): ["missing trade_count", "notional 10.5 < 100000000"], ("1s", "A"): []}
    assert [(r["horizon"], r["venue"]) for r in reversion.order_points(points).collect()] == [("500ms", "A"), ("1s", "A"), ("1s", "B"), ("10s", "A")]
    assert [r["horizon"] for r in reversion.order_points(points, horizons=["10s"]).collect()][0] == "10s"
    context = reversion.reversion_contexts(points).first()
    assert (context["max_positive"], context["max_absolute"], context["low_count"], context["context_sort_order"]) == (2.5, 3.0, 3, 3)
    facts_ = reversion.reversion_facts(points, n=2, m=1).collect()
    assert [(r["kind"], r["status"], r["value_text"]) for r in facts_] == [("headline", "alert", "+2.5000 bps"), ("headline", "watch", "+0.6000 bps"), ("low_confidence", "watch", "low confidence")]
    assert facts_[2]["metric_label"] == "+500ms Reversion sample size"
    for bad in ({"venue": "A"}, {"venue": "", "horizon": "1s"}):
        with pytest.raises(Exception, match="reversion point lacks"):
            reversion.curve_points(obs(spark, [(name, 0, "b", bad, 1.0)])).collect()
    with pytest.raises(ValueError):
        reversion.rank_contexts(reversion.reversion_contexts(points), "best")
    assert reversion.reversion_curves(points).count() == 2 and reversion.reversion_facts(points.limit(0)).count() == 0


def test_commentary(spark):
    cmp = compare.compare(obs(spark, [("quoted_spread_bps", 0, "AMO", {"market_cap_bucket": "large"}, 12.0), ("unknown_id", 0, None, {}, None)]),
                          history(spark, "quoted_spread_bps", [10, 11, 12], {"market_cap_bucket": "large"}, "AMO"))
    said = {r["metric_label"]: r["comment"] for r in commentary.commentary_text(commentary.order_facts(commentary.commentary_facts(cmp))).collect()}
    assert said["Quoted Spread"].startswith(
        "Quoted Spread comparison for Market cap bucket: Large cap, Intraday bucket: AM opening auction: current 12.0000 bps versus reference 11.0000 bps (change +1.0000 bps +9.1%); statistical score not shown.")
    assert "Low confidence: 3 reference observations" in said["Quoted Spread"] and "current not available" in said["unknown_id"]
    summary = commentary.commentary_text(commentary.section_summary(cmp.limit(0), "Empty")).first()
    assert summary["comment"] == "Empty headline: no comparison rows were available across all comparisons."
    assert commentary.dominant_method(cmp.limit(0)).first()[0] == "same_intraday_bucket"
    assert commentary.order_facts(commentary.commentary_facts(cmp).unionByName(commentary.section_summary(cmp, "Top"))).first()["fact_type"] == "section_summary"


def test_labels(spark):
    rows = [(1234567.0, "JPY", "1,234,567 JPY"), (0.5, "ratio", "0.5000"), (12.0, "count", "12"), (1.25, "bps", "1.2500 bps"), (2.0, "", "2.0000"), (float("nan"), "bps", "not available"), (None, "bps", "not available")]
    frame = spark.createDataFrame(rows, "v double, u string, e string")
    assert all(r["t"] == r["e"] for r in frame.select("e", labels.value_text(F.col("v"), F.col("u")).alias("t")).collect())
    assert all(r[0] == "not available" for r in frame.where("v is null").select(labels.signed_value_text(F.col("v"), F.col("u"))).collect())
    texts = spark.range(1).select(
        labels.bucket_label(F.lit("9:00-9:05")).alias("a"), labels.group_key_label(F.lit("sbij_id")).alias("b"), labels.bucket_label(F.lit(" ")).alias("c"),
        labels.card_text(F.lit(1500.0), F.lit("shares")).alias("d"), labels.delta_text(F.lit(-0.5)).alias("e"), labels.scope_label(F.lit(DAY), F.lit(None).cast("string"), F.create_map(F.lit("venue"), F.lit("TSE"))).alias("f")).first()
    assert tuple(texts) == ("9:00–9:05", "SBIJ ID", None, "1.5K", "↓ 50.0%", "Date: 2024-03-01, Venue: TSE")
    anchors = spark.createDataFrame([(" A_b/c ",), ("日本",)], "s string").select(scalars.symbol_anchor(F.col("s"))).collect()
    assert anchors[0][0].startswith("symbol-detail-a_b-c-") and anchors[1][0].startswith("symbol-detail-") and anchors[1][0].count("-") == 2
    with pytest.raises(Exception, match="must not be empty"):
        spark.createDataFrame([(" ",)], "s string").select(scalars.symbol_anchor(F.col("s"))).collect()
    assert scalars.duration_ms("10s") == 10_000 and scalars.bucket_ms("1d") == 86_400_000
    for bad in ("1d", "0s", "5", "s", "05m"):
        with pytest.raises(ValueError):
            scalars.duration_ms(bad)


def test_calendar_and_grid(spark):
    assert calendar.weekdays_between(spark, "2024-03-01", "2024-03-10").count() == 6
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(10)] * 2, "date date")
    assert calendar.trading_days(days, "2024-03-02", "2024-03-04").count() == 3
    assert sorted(r["date"].day for r in calendar.reference_window(days, "2024-03-06", 3).collect()) == [3, 4, 5]
    for call in (lambda: calendar.trading_days(days, "2024-03-05", "2024-03-04"), lambda: calendar.require_days(days.limit(0), "2024-03-01", "2024-03-02"),
                 lambda: calendar.require_days(days, "2024-03-01", "2024-03-02"), lambda: calendar.filter_universe(days, ["a"], "b"), lambda: calendar.bucket_grid(spark, [], "5m"), lambda: calendar.bucket_grid(spark, [(0, 1)], "5s")):
        with pytest.raises(ValueError):
            call()
    grid = calendar.bucket_grid(spark, [(32_400_000, 41_400_000), (45_000_000, 55_800_000)], "1h").orderBy("sort_order").collect()
    assert [r["label"] for r in grid] == ["AMO", "9:00-10:00", "10:00-11:00", "11:00-11:30", "AMC", "PMO", "12:30-13:30", "13:30-14:30", "14:30-15:30", "PMC"]
    assert [r["sort_order"] for r in grid] == list(range(1, 11)) and calendar.bucket_grid(spark, [(0, 3_600_000)] * 3, "30m", auctions=False).count() == 6
    dates = spark.createDataFrame([("2024.03.01",), ("2024-03-01",), ("2024-03-01 10:00:00",), ("x",), (None,)], "d string").select(calendar.coerce_date(F.col("d"))).collect()
    assert [r[0] for r in dates] == [DAY, DAY, DAY, None, None]
    refs = spark.createDataFrame([(DAY, "A"), (DAY, ""), (DAY, "A"), (DAY, None)], "date date, sym string")
    assert calendar.universe(refs).collect()[0]["sym"] == "A" and calendar.filter_universe(refs, []).count() == 4 and calendar.in_universe(refs, refs.where("sym = 'A'")).count() == 2


def test_sources_and_contracts(spark):
    def empty(role):
        return spark.createDataFrame([], ", ".join(f"{c} {'date' if c == 'date' else 'string'}" for c in ticks.CONTRACTS[role]))

    tables = {"trades": empty("trades").withColumn("venue", F.lit("x")), "quotes": empty("quotes").withColumn("venue", F.lit("x")), "refs": empty("refs")}
    loaded = ticks.load_sources(tables, ["turnover", "volume", "quoted_spread_bps", "primary_quote_reversion_1s_bps"], ["2024-03-01"], tables["refs"])
    assert list(loaded) == ["trades", "quotes", "pts_trades", "pts_quotes", "primary_quotes"]
    assert ticks.load_refs(spark, {}).columns == list(ticks.CONTRACTS["refs"]) and ticks.load_refs(spark, tables, []).count() == 0
    with pytest.raises(ValueError, match="quotes \\(quotes\\) lacks: askSize"):
        ticks.load_sources({"quotes": tables["quotes"].drop("askSize")}, ["top_of_book_depth"])
    with pytest.raises(ValueError, match="no table for role trades"):
        ticks.load_sources({}, ["turnover"])
    with pytest.raises(ValueError):
        ticks.roles_of(["mood"])
    with pytest.raises(ValueError, match="turnover lacks: sym"):
        observations.require_output(spark.createDataFrame([], "date date, time_bucket string, turnover double"), "turnover", ("sym",))


def test_asof_edges(spark):
    schema = "date date, sym string, t long, seq long, mid double"
    left = spark.createDataFrame([(DAY, "A", 5, 1, 0.0), (DAY, "A", 5, 1, 0.0), (DAY, "A", 1, 2, 0.0), (DAY, None, 9, 3, 0.0), (DAY, "B", 9, 4, 0.0)], schema)
    right = spark.createDataFrame([(DAY, "A", 5, 1, 1.0), (DAY, "A", 5, 2, 2.0), (DAY, "A", 9, 3, 3.0), (DAY, "B", 2, 4, 4.0)], schema)
    found = asof.asof_join(left, right, ["date", "sym"], ["mid"], "t", "t", max_age=5).collect()
    assert sorted((r["seq"], r["r_mid"]) for r in found if r["r_mid"] is not None) == [(1, 2.0), (1, 2.0)] and len(found) == 5
    assert asof.asof_join(left, right.limit(0), ["date", "sym"], ["mid"], "t", "t").where("r_mid is null").count() == 5


def test_asof_blocks(spark):
    """Blocks of time change no match: gaps of several blocks, ties at their borders, times outside the day and none at all."""
    draw = random.Random(5)
    times = [None, -5, 0, 999, 1000, 1001, 86_399_999, 86_400_000, 90_000_000] + [draw.randrange(40_000_000) for _ in range(60)]
    schema = "date date, sym string, t long, seq long, mid double"
    left = [(DAY, draw.choice("ABC"), t, i, 0.0) for i, t in enumerate(times * 2)]
    right = [(DAY, draw.choice("AB"), t, i, float(i)) for i, t in enumerate(draw.sample(times, 30) + [0, 1000, 1000, None, 86_399_999])]
    expected = {}
    for _, sym, t, i, _ in left:
        fits = [(u, j, mid) for _, s, u, j, mid in right if s == sym and None not in (t, u) and u <= t]
        expected[i] = max(fits)[2] if fits else None
    frames = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for block_ms in (1000 * 60, asof.BLOCK_MS, asof.DAY_MS):
        found = asof.asof_join(*frames, ["date", "sym"], ["mid"], "t", "t", block_ms=block_ms).collect()
        assert len(found) == len(left) and {r["seq"]: r["r_mid"] for r in found} == expected


def test_facts_edges(spark):
    trades = spark.createDataFrame([(DAY, 32_400_000, "A", "am", 1, 10.0, 5.0), (DAY, 32_400_000, "A", "am", 1, 10.0, 5.0), (DAY, 32_400_000, None, "am", 0, 1.0, 1.0), (DAY, 1, "A", "am", 0, -1.0, 1.0)],
                                   "date date, time_ms long, sym string, session string, auction int, tradePrice double, tradeSize double")
    refs = spark.createDataFrame([(DAY, "B", "R", "Large", 100)], ", ".join(f"{c} {t}" for c, t in zip(ticks.CONTRACTS["refs"], ("date", "string", "string", "string", "long"))))
    row = facts.activity(trades, refs, 300_000).collect()
    assert [(r["time_bucket"], r["topixCapGrp"], r["turnover"], r["trade_count"]) for r in row] == [("AMO", None, 100.0, 2)]
    quotes = spark.createDataFrame([(DAY, 1, "B", 9.0, 11.0, 100.0, None), (DAY, 2, "B", 9.0, 11.0, 100.0, 300.0), (DAY, 2, "A", 9.0, 11.0, 1.0, 1.0), (DAY, 2, "B", 11.0, 11.0, 1.0, 1.0)],
                                   "date date, time_ms long, sym string, bidPrice double, askPrice double, bidSize double, askSize double")
    row = facts.liquidity(quotes, refs, 300_000).collect()
    assert [(r["sym"], r["quoted_spread_bps"], r["top_of_book_depth"]) for r in row] == [("B", 2000.0, 4.0)]
    assert facts.rollup_medians(quotes, refs, ["market", "mood"], 300_000).first()["quoted_spread_bps"] == 2000.0


def test_store(spark, tmp_path):
    rows = obs(spark, [("turnover", 0, "b", {"sym": "A"}, 1.0), ("turnover", 1, None, {}, 2.0), ("volume", 0, "b", {"sym": "A", "venue": "V"}, 3.0), ("volume", 0, "b", {"venue": "V", "sector": "Z"}, 4.0)])
    wide = observations.to_stock_metrics(rows, "5m", ["turnover", "volume"])
    kinds = {(r["sym"], r["groupType"], r["groupValue"], r["timeBucket"]) for r in wide.collect()}
    assert kinds == {("A", "symbol", "A", "b"), ("ALL", "market", "ALL", "FULL_DAY"), ("A", "venue", "V", "b"), ("ALL", "sector|venue", "Z|V", "b")}
    path = str(tmp_path / "store")
    for _ in range(2):
        observations.write_stock_metrics(wide, path)
    back = observations.from_stock_metrics(spark.read.parquet(path), ["turnover", "volume", "mood"])
    assert back.count() == 4 and {'{"sym":"A","venue":"V"}', '{"sector|venue":"Z|V"}', "{}"} <= {r["group_key"] for r in back.collect()}
    later = wide.where("turnover is not null").withColumn("turnover", F.lit(9.0)).drop("volume")
    assert sorted(r["turnover"] for r in observations.merge_stock_metrics(wide, later).where("turnover is not null").collect()) == [9.0, 9.0]
    points = observations.report_arrays(rows.where("metric_name = 'turnover'"), ["metric_name"], ["date"], ["time_bucket", "value"]).first()["points"]
    assert points == '[{"time_bucket":"b","value":1.0},{"value":2.0}]'
    observations.write_report_table(rows.select("metric_name", "value"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 4
    assert [r["metric_name"] for r in observations.first_seen(rows, "metric_name", ["date", "value"]).collect()] == ["turnover", "volume"]
    assert observations.prefix_cut(rows, ["value"], 2).count() == 2 and observations.label_periods(rows, rows).where("period = 'target'").count() == 4
