"""Tables of ticks laid out for the engine, and user functions that give tables by role.

A stored table is partitioned by date, and bucketed and sorted by symbol: dates prune partitions, and aggregates and joins by
symbol need no shuffle. Dates are few and named one by one; symbols are many and stay a table.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.ticks import CONTRACTS, FALLBACKS, require_columns, roles_of


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or else the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: for results that several tables are made from."""
    path = f"{shared_folder(df.sparkSession)}/written_{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def on_dates(df: DataFrame, dates: list[dt.date]) -> DataFrame:
    """Rows of the named dates; literals, so that they prune partitions."""
    return df.where(F.col("date").isin(*dates) if dates else F.lit(False))


class TickStore:
    """Stored tables by role under one folder, read and written through a session of its own.

    The session plans joins on (date, sym) over tables bucketed by sym without another shuffle. A bucket of a date is one
    sorted file. Writing a role replaces its whole table; nulls in date or sym are stored like any value, an empty table gives an
    empty one.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, buckets: int = 8):
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.folder, self.name, self.buckets = folder.rstrip("/"), name, buckets

    def _table(self, role: str) -> str:
        return f"{self.name}_{role}"

    def write(self, role: str, df: DataFrame) -> None:
        order = [c for c in ("sym", "time_ms") if c in df.columns]
        dealt = df.repartition(self.buckets, "sym")  # as the buckets are, so that a task writes one file a date
        self.session.sql(f"DROP TABLE IF EXISTS {self._table(role)}")
        writer = dealt.write.mode("overwrite").format("parquet").option("path", f"{self.folder}/{self._table(role)}")
        writer.partitionBy("date").bucketBy(self.buckets, "sym").sortBy(*order).saveAsTable(self._table(role))

    def read(self, role: str) -> DataFrame:
        return self.session.table(self._table(role))

    def sources(self, *roles: str) -> Sources:
        """The stored roles as source functions."""
        found = Sources()
        for role in roles:
            if role == "refs":
                found.register("refs", lambda dates: on_dates(self.read("refs"), dates))
            else:
                found.register(role, lambda dates, refs, role=role: on_dates(self.read(role), dates))
        return found


class Sources:
    """User functions by role: `refs(dates)`, and `function(dates, refs)` for ticks, where refs is the universe of the dates."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable[..., DataFrame]] = {}

    def register(self, role: str, function: Callable[..., DataFrame]) -> Sources:
        if role != "refs" and role not in {n for r, names in FALLBACKS.items() for n in (r, *names)} | set(CONTRACTS):
            raise ValueError(f"unknown role: {role}")
        if not callable(function):
            raise ValueError(f"the source of {role} is no function")
        self.functions[role] = function
        return self

    def load(self, metrics: list[str], dates: list[dt.date]) -> dict[str, DataFrame]:
        """The tables that the metrics need, by role, and refs; each function is called once with the dates and the universe.

        A role without a function of its own falls back in the order of FALLBACKS. Rows of other dates, which a function
        should not give, are left out.
        """
        if "refs" not in self.functions:
            raise ValueError("no source for role refs")
        refs = on_dates(require_columns(self.functions["refs"](dates), *CONTRACTS["refs"], role="refs"), dates)
        given: dict[str, DataFrame] = {}
        out = {"refs": refs}
        for role in roles_of(metrics):
            name = next((n for n in FALLBACKS.get(role, (role,)) if n in self.functions), None)
            if name is None:
                raise ValueError(f"no source for role {role}")
            if name not in given:
                given[name] = self.functions[name](dates, refs)
            out[role] = on_dates(require_columns(given[name], *CONTRACTS[role], role=role, table=name), dates)
        return out
