"""One-pass joins and comparisons, mergeable medians and levels, rank statistics, sources, stores and contracts on small tables."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels
from tidewatch.operators import asof, compare, facts, observations, overview, ranks, trends
from tidewatch.functions.scalars import time_bucket_continuous
from tidewatch.plans import base, registry
from tidewatch.sources import ticks
from tidewatch.sources.store import Sources, TickStore

DAY = dt.date(2024, 3, 1)
QUOTE = "date date, time_ms long, sym string, venue string, bidPrice double, askPrice double, seq long"
TRADE = "date date, time_ms long, sym string, venue string, session string, auction int, tradePrice double, tradeSize double, seq long"


def market(seed, n=600):
    draw = random.Random(seed)
    times = [draw.randrange(0, 40_000_000) for _ in range(25)] + [0, 7_200_000, 7_199_999, 86_399_999]

    def at():
        return draw.choice(times) if draw.random() < 0.5 else draw.randrange(0, 40_000_000)

    quotes = [(DAY, at(), draw.choice(["A", "B", None]), draw.choice(["X", "Y"]), float(draw.randrange(0, 6)), float(draw.randrange(1, 8)), i) for i in range(n)]
    trades = [(DAY, at() if draw.random() < 0.97 else None, draw.choice(["A", "B", "C", None]), draw.choice(["X", "Y", None]), "am", draw.choice([0, 0, 0, 1]), draw.uniform(0, 6), float(draw.randrange(0, 5)), i)
              for i in range(n)]
    return trades + trades[:3], quotes[: n // 2], quotes[n // 2:]


def brute_scores(trades, own, primary, horizons, age):
    def last(quotes, sym, at, venue=None):
        fits = [(q[1], q[6], (q[4] + q[5]) / 2) for q in quotes if q[2] == sym and q[1] <= at and q[5] > q[4] > 0 and (venue is None or q[3] == venue)]
        return max(fits) if fits else None

    out = []
    for _, t, sym, venue, _, auction, price, size, seq in trades:
        if None in (t, sym, venue) or auction or price <= 0 or size <= 0:
            continue
        mine, before = last(own, sym, t, venue), last(primary, sym, t)
        if not mine or not before or t - mine[0] > age or t - before[0] > age or price == mine[2]:
            continue
        side = 1 if price > mine[2] else -1
        for name, h in horizons.items():
            after = last(primary, sym, t + h)
            if after and t + h - after[0] <= age:
                out.append((seq, name, round(side * 10000 * (after[2] - before[2]) / after[2], 6)))
    return sorted(out)


@pytest.mark.parametrize("block_ms", [600_000, asof.BLOCK_MS, asof.DAY_MS])
def test_reversion_scores_against_brute_force(spark, block_ms):
    trades, own, primary = market(4)
    horizons = {"1ms": 1, "1s": 1000, "30m": 1_800_000, "2h": 7_200_000}
    frames = spark.createDataFrame(trades, TRADE), spark.createDataFrame(own, QUOTE), spark.createDataFrame(primary, QUOTE)
    found = asof.score_reversion(*frames, list(horizons), 9_000_000, block_ms=block_ms)
    expected = brute_scores(trades, own, primary, horizons, 9_000_000)
    assert sorted((r["seq"], r["horizon"], round(r["bps"], 6)) for r in found.collect()) == expected and len(expected) > 20
    assert asof.score_reversion(frames[0], frames[1], frames[2].limit(0), ["1s"], 5).count() == 0
    assert asof.score_reversion(frames[0].limit(0), frames[1], frames[2], ["1s"], 5).count() == 0
    some = asof.score_reversion(*frames, ["1s"], 9_000_000, venues=("Y",), primary_venue="X")
    kept = [t for t in trades if t[3] == "Y"], [q for q in own if q[3] == "Y"], [q for q in primary if q[3] == "X"]
    assert sorted((r["seq"], r["horizon"], round(r["bps"], 6)) for r in some.collect()) == brute_scores(*kept, {"1s": 1000}, 9_000_000)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reversion_shuffles_ticks_once(spark):
    trades, own, primary = market(4)
    frames = spark.createDataFrame(trades, TRADE), spark.createDataFrame(own, QUOTE), spark.createDataFrame(primary, QUOTE)
    assert plan_of(asof.score_reversion(*frames, ["1s", "5s"], 5000)).count("Exchange hashpartitioning") == 1


def test_histogram_median(spark):
    draw = random.Random(2)
    rows = []
    for g in ("a", "b", None):
        for v in [draw.choice([-3.5, 0.0, 1e-9, 2.0, 2.0000001, 7e8, draw.gauss(0, 5)]) for _ in range(draw.randrange(1, 60))]:
            rows.append((g, v, draw.randrange(1, 4)))
    rows += [("one", 4.0, 1), ("even", 1.0, 1), ("even", 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, value double, n long").groupBy("g", "value").agg(F.sum("n").alias("n"))
    expected = {g: float(np.median([v for h, v, n in rows if h == g for _ in range(n)])) for g in {r[0] for r in rows}}
    found = {r["g"]: r["median"] for r in facts.histogram_median(df, ["g"]).collect()}
    assert found == pytest.approx(expected)
    assert facts.histogram_median(df.limit(0), ["g"]).count() == 0
    bins = spark.createDataFrame([(v,) for v in (-1e300, -2.0, -1e-300, 0.0, 5e-324, 1.0, 1.01, 1.1, 1e300, float("inf"), float("nan"))], "v double")
    assert [r["b"] for r in bins.select(facts.value_bin(F.col("v")).alias("b")).collect()] == sorted(r["b"] for r in bins.select(facts.value_bin(F.col("v")).alias("b")).collect())


def test_reversion_partitions_are_not_joined_again(spark):
    """Sorts and windows hold many times the packed size by which partitions would be joined."""
    trades, own, primary = market(4)
    frames = spark.createDataFrame(trades, TRADE), spark.createDataFrame(own, QUOTE), spark.createDataFrame(primary, QUOTE)
    plan = plan_of(asof.score_reversion(*frames, ["1s", "5s"], 5000))
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1


def test_levels_of_quotes_ranges_and_reversion(spark):
    refs = spark.createDataFrame([(DAY, "A", "R", "Large", 10), (DAY, "B", "R", "Small", 20)], "date date, sym string, ric string, topixCapGrp string, lotSize long")
    quotes = spark.createDataFrame([(DAY, 1, "A", 9.0, 11.0, 100.0, 100.0), (DAY, 2, "A", 9.0, 11.0, 300.0, 100.0), (DAY, 2, "B", 19.0, 21.0, 100.0, 300.0), (DAY, 3, "B", 19.0, 21.0, None, 1.0), (DAY, 3, "Z", 1.0, 2.0, 1.0, 1.0)],
                                   "date date, time_ms long, sym string, bidPrice double, askPrice double, bidSize double, askSize double")
    for accuracy in (None, 10_000):
        level = {(r["aggregationLevel"], r["groupValue"]): (round(r["quoted_spread_bps"], 6), r["top_of_book_depth"]) for r in facts.rollup_medians(quotes, refs, ["market", "symbol", "mood"], 600_000, accuracy).collect()}
        assert level["symbol", "A"] == (2000.0, 30.0 if accuracy is None else 20.0) and level["symbol", "B"] == (1000.0, 20.0)
        assert level["market", "TSE"] == (1500.0 if accuracy is None else 1000.0, 20.0) and len(level) == 3
    trades = spark.createDataFrame([(DAY, t, s, p) for t, s, p in [(1, "A", 10.0), (2, "A", 11.0), (700_000, "A", 12.0), (1, "B", 5.0), (2, "B", 5.0), (3, None, 1.0), (3, "B", -1.0)]], "date date, time_ms long, sym string, tradePrice double")
    level = {(r["aggregationLevel"], r["time_bucket"], r["groupValue"]): (r["parkinson_volatility_bps"], r["symbols"]) for r in facts.rollup_parkinson(trades, refs, list(facts.LEVELS), 600_000).collect()}
    bps = 10000 * abs(math.log(1.2)) / math.sqrt(4 * math.log(2))
    assert level["symbol", None, "A"] == pytest.approx((bps, 1)) and level["symbol", None, "B"] == (0.0, 1) and level["market", None, "TSE"] == pytest.approx((bps / math.sqrt(2), 2))
    assert level["topix_cap_group", None, "Small"][0] == 0.0 and level["symbol_bucket", "00:10:00.000", "A"][0] == 0.0 and len([k for k in level if k[0] == "market_bucket"]) == 2


def test_facts_of_one_pass_equal_the_single_facts(spark):
    load = {v: ticks.load(spark, "/root/testdata/sf0.001", v) for v in ("trades", "quotes", "refs")}
    both = facts.observations(load["trades"], load["quotes"], load["refs"], 1_800_000)
    single = observations.flatten(
        observations.to_observations(facts.activity(load["trades"], load["refs"], 1_800_000), ["turnover", "volume", "trade_count"]),
        observations.to_observations(facts.liquidity(load["quotes"], load["refs"], 1_800_000), ["quoted_spread_bps", "top_of_book_depth"]),
        observations.to_observations(facts.parkinson(load["trades"], load["refs"], 1_800_000), ["parkinson_volatility_bps"]))

    def rows(df):
        return sorted((r["metric_name"], str(r["date"]), r["time_bucket"], r["group_key"], round(r["value"], 9)) for r in df.collect())

    assert plan_of(both).count("FileScan parquet") == 3 and rows(both) == rows(single)


def test_rank_statistics():
    draw = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 65, 130, 700):
        for values in (draw.normal(size=n), draw.integers(0, 4, n).astype(float), np.arange(n) * 0.1, np.full(n, 2.0), np.arange(n) * 1.5 + draw.normal(size=n) * 0.01):
            i, j = np.triu_indices(n, 1)
            assert ranks.inversions(values) == (values[i] > values[j]).sum()
            slope = ranks.median_slope(values)
            assert slope is None if n < 2 else slope == pytest.approx(np.median((values[j] - values[i]) / (j - i)), abs=1e-9)
    for n in (2, 3, 4, 5, 6):
        found = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in itertools.permutations(range(n))]
        for d in range(n * (n - 1) // 2 + 1):
            far = abs(d - n * (n - 1) / 4)
            assert ranks.exact_tail(n, d) == pytest.approx(sum(abs(f - n * (n - 1) / 4) >= far for f in found) / len(found))
    assert ranks.exact_tail(200, 0) == 0.0 and 0 < ranks.exact_tail(33, 200) < 1


def test_rank_statistics_of_series(spark):
    rows = [("flat", DAY + dt.timedelta(days=i), 1.0) for i in range(6)] + [("one", DAY, 3.0), ("none", DAY, None)]
    rows += [("up", DAY + dt.timedelta(days=i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "metric_name string, date date, value double")
    found = {r["metric_name"]: r for r in trends.kendall(df).collect()}
    assert set(found) == {"flat", "up"} and found["flat"]["p_value"] == 1.0 and found["up"]["tau"] == 1.0
    assert found["up"]["p_value"] == pytest.approx(2 / math.factorial(40), abs=0) and trends.kendall(df, exact=False).where("metric_name = 'up'").first()["p_value"] == pytest.approx(0.0, abs=1e-9)
    assert {r["metric_name"]: r["slope"] for r in trends.theil_sen(df).collect()} == {"flat": 0.0, "up": 1.0}
    assert trends.kendall(df.limit(0)).count() == 0


def observed(spark, rows):
    shaped = [(m, DAY + dt.timedelta(days=d), b, g, float(v) if v is not None else None, {}, i) for i, (m, d, b, g, v) in enumerate(rows)]
    df = spark.createDataFrame(shaped, "metric_name string, date date, time_bucket string, `group` map<string,string>, value double, metadata map<string,string>, seq int")
    return df.withColumn("group_key", observations.group_key(F.col("group")))


def test_comparison_of_periods_in_one_table(spark):
    rows = [("m", d, "b", {"sym": "A"}, d * d) for d in range(-12, 0)] + [("m", -3, "b", {"sym": "A"}, 100.0), ("m", 0, "b", {"sym": "A"}, 9.0), ("m", 0, "b", {"sym": "A"}, 9.0), ("m", 0, None, {}, 1.0), ("m", -1, None, {}, None)]
    obs = observed(spark, rows)
    now, was = F.col("date") == F.lit(DAY), F.col("date") < F.lit(DAY)
    for fold, at in (("mean", (9 + 100) / 2), ("median", (9 + 100) / 2), ("sum", 109), ("first", 9), ("last", 100)):
        days = sorted([float(d * d) for d in range(-12, 0) if d != -3] + [at])
        found = compare.compare_periods(obs, now, was, fold=fold).collect()
        assert sorted(r["reference_sample_size"] for r in found) == [0, 12, 12]
        assert {r["reference_value"] for r in found} == {None, float(np.median(days))}
        other = compare.compare(obs.where(now), obs.where(was), fold=fold).collect()
        assert sorted((r["reference_sample_size"], r["empirical_percentile"] or 0) for r in other) == sorted((r["reference_sample_size"], r["empirical_percentile"] or 0) for r in found)
    with pytest.raises(ValueError):
        compare.compare_periods(obs, now, was, fold="mode")
    assert compare.compare_periods(obs.limit(0), now, was).count() == 0


def test_report_order_and_top_changes(spark):
    schema = "metric_name string, date date, time_bucket string, `group` map<string,string>, group_key string, value double, reference_value double, change_abs double, change_pct double, z_score double, status string"
    rows = [(m, DAY, b, {"sector": g}, g, 1.0, 1.0, 0.0, c, z, s) for m, b, g, c, z, s in [
        ("volume", "b", "x", 0.9, 2.0, "alert"), ("turnover", "b", "x", 0.1, 2.0000000001, "alert"), ("volume", "a", "y", 0.5, 3.0, "watch"), ("zzz", "a", "y", None, None, "normal"), ("volume", "c", "z", 0.7, 1.0, "alert")]]
    cmp = spark.createDataFrame(rows, schema)
    assert [(r["metric_name"], r["status"]) for r in overview.comparison_table(cmp).collect()] == [("turnover", "alert"), ("volume", "alert"), ("volume", "alert"), ("volume", "watch"), ("zzz", "normal")]
    top = overview.top_changes(cmp, n=3)
    assert [(r["metric_name"], r["time_bucket"]) for r in top.collect()] == [("volume", "b"), ("turnover", "b"), ("volume", "c")] and "WindowGroupLimit" in plan_of(top)
    table = overview.drilldown_table(cmp, 2).collect()
    assert [(r["dimension"], r["dimension_value"]) for r in table] == [("Sector", "x"), ("Sector", "x")]
    symbols = cmp.withColumn("group", F.create_map(F.lit("sym"), F.col("group_key")))
    found = overview.symbol_table(symbols, spark.createDataFrame([("x",), ("q",)], "symbol string"), 1).collect()
    assert [(r["symbol"], r["place"], r["metric_name"]) for r in found] == [("x", 1, "turnover")]


def test_sources_by_role(spark, tmp_path):
    load = {v: ticks.load(spark, "/root/testdata/sf0.001", v) for v in ("trades", "quotes", "refs", "pts_trades")}
    store = TickStore(spark, str(tmp_path), "t_sources")
    for role in ("trades", "refs"):
        store.write(role, load[role])
    days, calls = [dt.date(2024, 1, 3), dt.date(2024, 1, 4)], []
    sources = store.sources("trades", "refs")
    plain = sources.functions["trades"]
    sources.register("trades", lambda dates, refs: calls.append((dates, refs)) or plain(dates, refs))
    found = sources.load(["turnover", "parkinson_volatility_bps"], days)
    assert len(calls) == 1 and calls[0][0] == days and set(found) == {"refs", "trades"}
    store.session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    facts_of = facts.activity(found["trades"], found["refs"], 1_800_000)
    plan = plan_of(facts_of)
    assert "Exchange" not in plan and plan.count("PartitionFilters: [isnotnull(date") + plan.count("PartitionFilters: [date") >= 2 and "SortMergeJoin" in plan
    wanted = facts.activity(load["trades"].where(F.col("date").isin(days)), load["refs"], 1_800_000)
    assert sorted(map(str, facts_of.collect())) == sorted(map(str, wanted.collect()))
    store.write("trades", load["trades"].limit(0))
    assert store.read("trades").count() == 0
    reversion = Sources().register("refs", lambda dates: load["refs"]).register("trades", lambda dates, refs: load["pts_trades"]).register("quotes", lambda dates, refs: load["quotes"])
    assert set(reversion.load(["primary_quote_reversion_1s_bps"], days)) == {"refs", "pts_trades", "pts_quotes", "primary_quotes"}
    assert reversion.load(["turnover"], [])["trades"].count() == 0
    for wrong in (lambda: Sources().load(["turnover"], days), lambda: Sources().register("mood", print), lambda: Sources().register("trades", 3),
                  lambda: Sources().register("refs", lambda dates: load["refs"]).load(["turnover"], days)):
        with pytest.raises(ValueError):
            wrong()


def test_metric_store_computes_what_is_absent(spark, tmp_path):
    rows = [("turnover", d, "b", {"sym": s}, d + 1) for d in range(3) for s in "AB"] + [("volume", d, "b", {"sym": "A"}, 5.0) for d in range(3)]
    obs = observed(spark, rows)
    days = [DAY + dt.timedelta(days=d) for d in range(3)]

    def compute(dates, names):
        return obs.where(F.col("date").isin(dates) & F.col("metric_name").isin(names))

    store = observations.StockStore(spark, str(tmp_path / "m"), "5m", ["turnover", "volume"])
    with pytest.raises(ValueError, match="nothing is stored"):
        store.read(days)
    assert observations.StockStore(spark, store.path, "5m", ["turnover"]).fill(days[:1], compute) == [(days[:1], ["turnover"])]
    assert store.fill(days[:2], compute) == [(days[:1], ["volume"]), (days[1:2], ["turnover", "volume"])]
    assert store.fill(days[:2], compute) == [] and store.fill([], compute) == []
    found = store.read(days)
    assert found.count() == 6 and "PartitionFilters: [date" in plan_of(store.read(days[:1])).replace("isnotnull(date#", "date") or "PartitionFilters" in plan_of(store.read(days[:1]))
    with pytest.raises(Exception, match="another day or metric"):
        store.fill(days, lambda dates, names: obs)
    assert {(r["date"], r["metric_name"]) for r in store.read(days).collect()} == {(d, m) for d in days[:2] for m in ("turnover", "volume")}


def test_contracts(spark):
    contract = observations.output_contract("primary_quote_reversion_1s_bps", ("sym", "venue"))
    assert contract.required[:6] == ("date", "time_bucket", "venue", "horizon", "sym", "primary_quote_reversion_1s_bps") and contract.documented[-1] == "context_sort_order"
    assert observations.output_contract("turnover", ("sym",)).required == ("date", "time_bucket", "sym", "turnover")
    df = spark.createDataFrame([], "extra int, turnover double, time_bucket string, date date")
    assert observations.output_contract("turnover").select(df).columns == ["date", "time_bucket", "turnover", "extra"]
    with pytest.raises(ValueError, match="lacks: sym"):
        observations.require_output(df, "turnover", ("sym",))
    trades = spark.createDataFrame([(DAY, 1, "A", "V", "am", 0, 1.0, 1.0, 1), (None, 1, "A", "V", "noon", 5, 0.0, -1.0, 2), (DAY, 90_000_000, None, None, None, None, None, None, 3)], TRADE)
    found = {r["rule"]: (r["rows"], r["violations"]) for r in ticks.row_violations({"trades": trades}).collect()}
    assert found == {"missing_key": (3, 2), "time_outside_day": (3, 1), "price_not_positive": (3, 1), "size_not_positive": (3, 1), "unknown_auction": (3, 1), "unknown_session": (3, 1)}
    seen_rows, seen = ticks.observe_rows(trades, "trades")
    assert seen_rows.count() == 3 and seen.get["missing_key"] == 2 and seen.get["rows"] == 3
    assert {r["violations"] for r in ticks.row_violations({"trades": trades.limit(0)}).collect()} == {0}
    with pytest.raises(ValueError):
        ticks.row_rules("mood")


@pytest.mark.parametrize("name", ["kpi_snapshot", "comparison_table", "overview_cards", "signed_texts"])
def test_texts_do_not_depend_on_partitions(spark, name):
    found = []
    for parts in ("1", "4", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted(map(str, registry.queries()[name](spark, "/root/testdata/sf0.01").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and found[0]


def test_reference_window_bounds_the_days(spark):
    plan = plan_of(base.compared(lambda view: ticks.load(spark, "/root/testdata/sf0.001", view)))
    assert plan.count("FileScan parquet") == 3 and "collect_list" in plan


def test_unit_names_and_chart_modes(spark):
    units = spark.createDataFrame([("trading_day",), (" time_bucket ",), ("jpy_id",), ("",), (None,)], "u string")
    assert [r["l"] for r in units.select(labels.unit_label(F.col("u")).alias("l")).collect()] == ["trading day", "intraday bucket", "jpy id", None, None]
    group = spark.createDataFrame([({"reference_observation_unit": "time_bucket"},)], "g map<string,string>")
    assert group.select(labels.group_label(F.col("g")).alias("l")).first()["l"] == "Reference observation unit: intraday bucket"
    obs = observed(spark, [("turnover", 0, "AMO", {"sym": "A"}, 5.0), ("turnover", 0, None, {}, 6.0)])
    texts = {m: [(r["x_text"], r["series_text"], r["metadata_text"]) for r in trends.chart_table(obs, m, reference=obs.limit(0)).orderBy("place").collect()] for m in trends.CHART_MODES}
    day = DAY.isoformat()
    assert set(texts["time_series"]) == {(f"{day} AM opening auction", "Sym: A", None), (day, None, None)}
    assert set(texts["intraday"]) == {("AM opening auction", "Sym: A", None), (day, None, None)}
    assert set(texts["reference_target"]) == {(day, "Sym: A, Intraday bucket: AM opening auction", "Period: target"), (day, None, "Period: target")}
    with pytest.raises(ValueError):
        trends.chart_table(obs, "mood")


def test_deviation_of_equal_days_is_zero(spark):
    value = 27.562470123456789  # 35 times this does not add up to 35 * value
    obs = spark.createDataFrame([("m", "b", "g", DAY + dt.timedelta(days=i), value) for i in range(36)], "metric_name string, time_bucket string, group_key string, date date, value double")
    current = F.col("date") == F.lit(DAY + dt.timedelta(days=35))
    row = compare.compare_periods(obs.withColumn("group", F.create_map().cast("map<string,string>")), current, ~current, robust=False, higher_is_better=F.lit(False)).first()
    assert row["reference_value"] == value and row["z_score"] is None and row["normal_adverse_tail"] is None


def test_heatmap_takes_the_greatest_unrounded_change(spark):
    rows = [("turnover", {"topixCapGrp": g}, c) for g, c in [("Mid", -0.0665632315502), ("Mid", 0.0665632315501), ("Mid", None), ("Small", 0.01), ("Small", float("nan"))]]
    cmp = spark.createDataFrame(rows, "metric_name string, group map<string,string>, change_pct double")
    assert {r["group_value"]: r["change_pct"] for r in overview.group_heatmap(cmp).collect()} == {"Mid": -0.0665632315502, "Small": 0.01}


def test_heatmap_takes_the_first_drilldown_of_equal_changes(spark):
    """A fall that alerts comes before a rise of the same size; without a finite change a row comes last."""
    rows = [("turnover", {"topixCapGrp": g}, c, s, b) for g, c, s, b in [
        ("Mid", 5 / 52, "normal", "14:30"), ("Mid", -5 / 52, "alert", "13:30"), ("Mid", 0.01, "alert", "09:00"), ("Small", -0.02, "watch", "10:00"), ("Small", 0.02, "watch", "09:00"),
        ("Large", float("nan"), "alert", "09:00"), ("Large", None, "alert", "09:00"), ("Large", 0.0, "normal", "10:00")]]
    cmp = spark.createDataFrame(rows, "metric_name string, group map<string,string>, change_pct double, status string, time_bucket string")
    assert {r["group_value"]: r["change_pct"] for r in overview.group_heatmap(cmp).collect()} == {"Mid": -5 / 52, "Small": 0.02, "Large": 0.0}


def test_rounding_of_sums_is_no_change(spark):
    schema = "metric_name string, date date, value double"
    current = spark.createDataFrame([("volatility", DAY, 0.1), ("volatility", DAY, 0.2), ("volatility", DAY, 0.3), ("turnover", DAY, 1.000001)], schema)
    reference = spark.createDataFrame([("volatility", DAY, math.sqrt(0.14 / 3) * (1 - 3e-16)), ("turnover", DAY, 1.0)], schema)
    cards = {r["metric_name"]: r for r in trends.overview_cards(current, reference).collect()}
    assert (cards["volatility"]["delta_text"], cards["volatility"]["direction"]) == ("0.0%", "flat")
    assert (cards["turnover"]["delta_text"], cards["turnover"]["direction"]) == ("↑ 0.0%", "up")


def test_bars_of_a_flat_series_have_one_height(spark):
    schema = "metric_name string, date date, value double"
    values = [22.397610, 22.397610 * (1 + 3e-16), 22.397610 * (1 - 3e-16)]
    flat = spark.createDataFrame([("m", DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)], schema)
    assert {(r["height"], r["mean_height"]) for r in trends.spark_bars(flat, flat).collect()} == {(55.0, 55.0)}
    near = spark.createDataFrame([("m", DAY, 1e9), ("m", DAY + dt.timedelta(days=1), 1e9 + 1)], schema)
    assert sorted(r["height"] for r in trends.spark_bars(near, flat).collect()) == [28.0, 96.0]


def test_trend_texts_are_rounded_once(spark):
    series = [("tied", [1.0, 2.0, 1.0, 1.0, 1.0]), ("steps", [1.0, 1.0, 2.0, 2.0, 1.0]), ("up", [1.0, 1.2, 1.1, 1.4, 1.5])]
    rows = [(n, DAY + dt.timedelta(days=i), v) for n, s in series for i, v in enumerate(s)]
    found = {r["metric_name"]: r for r in trends.classify_trend(spark.createDataFrame(rows, "metric_name string, date date, value double")).collect()}
    for r in found.values():
        assert f"(p={r['p_value']:.3f}, normalized slope={100 * r['normalized_slope']:.3f}%" in r["summary_text"]
    assert round(found["tied"]["p_value"], 6) == 0.4795 and "(p=0.480," in found["tied"]["summary_text"]


def test_reversion_makes_its_points_once_and_repeats_no_expression(spark):
    queries = registry.queries()
    plans = {n: queries[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() for n in ("reversion_family", "reversion_curves", "reversion_facts", "ordered_points")}
    # scans of trades, venue quotes, primary quotes and reference data, all once; the headline points of the facts are rows already
    assert {n: p.count("Relation [") for n, p in plans.items()} == {n: 4 for n in plans}
    # filters do not repeat the expression of a tick's time for each mention (69 times before)
    assert all(p.count("7919") < 30 for p in plans.values())


def test_reversion_labels_sums_not_trades(spark):
    plan = registry.queries()["rank_contexts_max_absolute_reversion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = 1 + next(n for n, line in enumerate(plan) if "AS weighted_bps" in line)
    assert any("format_string" in line for line in plan[:at]) and not any("format_string" in line for line in plan[at:])
    # only trades with a side and primary quotes reach the ranges of time, which are above the venue's own mid
    windows = [line for line in plan[at:] if "Window [" in line]
    assert [line.count("max(__primary") > 0 for line in windows] == [True, False] and "max(__pts" in windows[1], plan


def test_clock_labels_are_those_of_a_formatter(spark):
    times = [0, 9, 10, 59_999, 60_000, 32_400_000, 45_296_789, 86_399_999, 86_400_000, 400_000_000, -1, -1_800_000, -5_400_001, None]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    for size in (1, 7, 1000, 1_800_000):
        start = (F.col("t") - F.col("t") % size).cast("long")
        old = F.format_string("%02d:%02d:%02d.%03d", F.floor(start / 3_600_000), F.floor(start / 60_000) % 60, F.floor(start / 1000) % 60, start % 1000)
        assert df.where(~time_bucket_continuous(F.col("t"), size).eqNullSafe(old)).count() == 0
