"""Tick, quote and reference tables derived from the driver's lineitem table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: View definitions in order; each may use the earlier ones and {lineitem}.
VIEWS = {
    "ticks": """
SELECT CAST(date AS DATE) AS date, sym, seq, role, session, auction, venue, time_ms, s,
       CAST(10000 + 500*s + m % 41 + seq % 7 AS DOUBLE) / CAST(10 AS DOUBLE) AS px, CAST(100*q AS DOUBLE) AS size
FROM (
  SELECT d AS date, 'S' || CAST(s AS VARCHAR(8)) AS sym, seq, role, s, q,
    CAST(FLOOR(x / 60000) AS BIGINT) AS m,
    CASE WHEN x < 9000000 THEN 32400000 + x ELSE 45000000 + (x - 9000000) END AS time_ms,
    CASE WHEN x < 9000000 THEN 'am' ELSE 'pm' END AS session,
    CASE WHEN x < 60000 OR (x >= 9000000 AND x < 9060000) THEN 1
         WHEN (x >= 8940000 AND x < 9000000) OR x >= 19740000 THEN 2 ELSE 0 END AS auction,
    CASE WHEN v = 0 THEN 'SBIJ' WHEN v = 1 THEN 'JNX' ELSE 'ODX' END AS venue
  FROM (
    SELECT DATE '2024-01-01' + CAST(l_orderkey % 40 AS INT) AS d, CAST(l_suppkey % 8 AS INT) AS s,
      CASE WHEN l_linenumber % 2 = 0 THEN x0 - x0 % 60000 ELSE x0 END AS x,
      ((CAST(l_orderkey AS BIGINT)*10 + l_linenumber)*100000 + l_partkey)*1000 + l_suppkey % 1000 AS seq,
      CAST((l_orderkey*31 + l_linenumber*17 + l_partkey) % 3 AS INT) AS role,
      CAST(l_partkey % 3 AS INT) AS v, CAST(l_quantity AS BIGINT) AS q
    FROM (SELECT *, CAST((l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 19800000 AS BIGINT) AS x0
          FROM {lineitem}) l) a) b""",
    "refs": """
SELECT DISTINCT date, sym, 'R' || sym AS ric, CASE WHEN s % 3 = 0 THEN 'Large' WHEN s % 3 = 1 THEN 'Mid' ELSE 'Small' END AS topixCapGrp,
       CASE WHEN s % 2 = 0 THEN 'Prime' ELSE 'Standard' END AS market_segment, CAST(100 AS BIGINT) AS lotSize
FROM ticks WHERE s < 7""",
    "trades": """
SELECT date, time_ms, sym, session, auction, 'TSE' AS venue, px AS tradePrice, size AS tradeSize, seq FROM ticks WHERE role = 0""",
    "quotes": """
SELECT date, time_ms, sym, 'TSE' AS venue, px - CAST(1 + seq % 3 AS DOUBLE)/CAST(10 AS DOUBLE) AS bidPrice,
       px + CAST(seq % 7 - 1 AS DOUBLE)/CAST(10 AS DOUBLE) AS askPrice, size + CAST(100 AS DOUBLE) AS bidSize, size AS askSize, seq
FROM ticks WHERE role = 2""",
    "pts_trades": """
SELECT date, time_ms, sym, session, auction, venue, px AS tradePrice, size AS tradeSize, seq FROM ticks WHERE role = 0""",
    "pts_quotes": """
SELECT date, time_ms, sym, venue, px - CAST(1 AS DOUBLE)/CAST(10 AS DOUBLE) AS bidPrice,
       px + CAST(2 AS DOUBLE)/CAST(10 AS DOUBLE) AS askPrice, seq FROM ticks WHERE role = 1""",
}


def with_clause(lineitem: str = "lineitem") -> str:
    """The views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in VIEWS.items()).replace("{lineitem}", lineitem)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the lineitem table of sf_dir."""
    return spark.sql(f"{with_clause('{lineitem}')} SELECT * FROM {name}", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


#: Columns that each role's table must have; further ones are allowed.
CONTRACTS = {
    "refs": ("date", "sym", "ric", "topixCapGrp", "lotSize"),
    "trades": ("date", "time_ms", "sym", "session", "auction", "tradePrice", "tradeSize"),
    "quotes": ("date", "time_ms", "sym", "bidPrice", "askPrice", "bidSize", "askSize"),
    "pts_trades": ("date", "time_ms", "sym", "session", "auction", "venue", "tradePrice", "tradeSize"),
    "pts_quotes": ("date", "time_ms", "sym", "venue", "bidPrice", "askPrice"),
    "primary_quotes": ("date", "time_ms", "sym", "venue", "bidPrice", "askPrice"),
}
#: Tables that stand in for a role's own, in order.
FALLBACKS = {
    "pts_trades": ("pts_trades", "venue_trades", "trades"), "pts_quotes": ("pts_quotes", "venue_quotes", "quotes"), "primary_quotes": ("primary_quotes", "quotes")}
_ACTIVITY, _LIQUIDITY = ("turnover", "volume", "trade_count"), ("quoted_spread_bps", "top_of_book_depth")


def roles_of(metrics: list[str]) -> list[str]:
    """Roles that the metrics need, each once."""
    found = []
    for metric in metrics:
        if metric in _ACTIVITY or metric == "parkinson_volatility_bps":
            found += ["trades"]
        elif metric in _LIQUIDITY:
            found += ["quotes"]
        elif metric.startswith("primary_quote_reversion_"):
            found += ["pts_trades", "pts_quotes", "primary_quotes"]
        else:
            raise ValueError(f"unknown metric: {metric}")
    return list(dict.fromkeys(found))


def load_sources(tables: dict[str, DataFrame], metrics: list[str], dates: list[str] | None = None, refs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that the metrics need, by role, restricted to dates (partition pruning) and to the universe of refs."""
    out = {}
    for role in roles_of(metrics):
        name = next((n for n in FALLBACKS.get(role, (role,)) if n in tables), None)
        if name is None:
            raise ValueError(f"no table for role {role}")
        df = require_columns(tables[name], *CONTRACTS[role], role=role, table=name)
        if dates is not None:
            df = df.where(F.col("date").isin(*[F.lit(d).cast("date") for d in dates]) if dates else F.lit(False))
        out[role] = df if refs is None else df.join(refs.select("date", "sym"), ["date", "sym"], "left_semi")
    return out


def load_refs(spark: SparkSession, tables: dict[str, DataFrame], dates: list[str] | None = None) -> DataFrame:
    """Reference data of the dates; a typed empty table where there is none."""
    if "refs" not in tables:
        return spark.createDataFrame([], "date date, sym string, ric string, topixCapGrp string, lotSize long")
    refs = require_columns(tables["refs"], *CONTRACTS["refs"], role="refs")
    return refs if dates is None else refs.where(F.col("date").isin(*[F.lit(d).cast("date") for d in dates]) if dates else F.lit(False))


def require_columns(df: DataFrame, *names: str, role: str = "input", table: str | None = None) -> DataFrame:
    """Input contract: raises when required columns are missing; further columns are allowed."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{role} ({table or role}) lacks: {', '.join(missing)}")
    return df


#: Auction codes (0 continuous, 1 opening, 2 closing) and half days of a tick.
AUCTION_CODES, HALF_DAYS = (0, 1, 2), ("am", "pm")


def _missing(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def row_rules(role: str) -> dict[str, Column]:
    """The assumptions on a role's rows, each as the condition that a row breaks it. A null breaks only the first rule."""
    if role not in CONTRACTS:
        raise ValueError(f"unknown role: {role}")
    if role == "refs":
        return {"missing_key": _missing("date", "sym"), "blank_symbol": F.length("sym") == 0, "lot_size_not_positive": F.col("lotSize") <= 0}
    rules = {"missing_key": _missing("date", "sym", "time_ms"), "time_outside_day": (F.col("time_ms") < 0) | (F.col("time_ms") >= 86_400_000)}
    if role in ("pts_trades", "pts_quotes", "primary_quotes"):
        rules["missing_venue"] = F.coalesce(F.col("venue"), F.lit("")) == ""
    if "tradePrice" in CONTRACTS[role]:
        rules |= {"price_not_positive": F.col("tradePrice") <= 0, "size_not_positive": F.col("tradeSize") <= 0,
                  "unknown_auction": ~F.col("auction").isin(*AUCTION_CODES), "unknown_session": ~F.col("session").isin(*HALF_DAYS)}
    else:
        rules |= {"bid_not_positive": F.col("bidPrice") <= 0, "crossed_or_locked": F.col("askPrice") <= F.col("bidPrice")}
    if "bidSize" in CONTRACTS[role]:
        rules["negative_size"] = (F.col("bidSize") < 0) | (F.col("askSize") < 0)
    return rules


def _violations(role: str) -> list[Column]:
    return [F.count("*").alias("rows"), *[F.count_if(F.coalesce(broken, F.lit(False))).alias(name) for name, broken in row_rules(role).items()]]


def row_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each role's table and how many of them break each rule, one row per role and rule; one pass over each table."""
    found = []
    for role, df in tables.items():
        counts = require_columns(df, *CONTRACTS[role], role=role).agg(*_violations(role))
        pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in row_rules(role)])
        found.append(counts.select(F.lit(role).alias("role"), "rows", F.inline(pairs)))
    return reduce(DataFrame.unionByName, found)


def observe_rows(df: DataFrame, role: str) -> tuple[DataFrame, Observation]:
    """df as it is, with an observation that counts its rows and violations in the pass of whatever action reads it first."""
    seen = Observation(f"{role} contract")
    return require_columns(df, *CONTRACTS[role], role=role).observe(seen, *_violations(role)), seen
