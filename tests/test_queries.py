"""Every market query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from tidewatch.plans import base, registry, reports
from tidewatch.sources import ticks

#: Ticks of one tape: enough history for every score and selection to have rows.
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        out.append(tuple("" if pd.isna(v) else f"{v + 0.0:.4f}" if isinstance(v, float) else f"{v:.4f}" if hasattr(v, "item") else str(v)[:10] if hasattr(v, "year") else
                         f"{float(v):.4f}" if isinstance(v, int) else str(v) for v in row))
    return sorted(out)


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    """Views, observations and comparisons are computed once for all queries of this module."""
    patch, made = pytest.MonkeyPatch(), {}

    def once(make, key):
        def cached(*args, **options):
            name = (make.__name__, key(*args), repr(options))
            if name not in made:
                made[name] = make(*args, **options).persist()
            return made[name]

        return cached

    patch.setattr(ticks, "load", once(ticks.load, lambda spark, folder, view: (folder, view)))
    for name in ("observations", "compared", "scored", "reversion_obs"):
        plain = getattr(base, name)
        shared = once(plain, lambda load, *rest: repr(rest))
        for module in (base, registry, reports):
            if getattr(module, name, None) is plain:
                patch.setattr(module, name, shared)
    yield
    patch.undo()
    for frame in made.values():
        frame.unpersist()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DIR}/lineitem.parquet'")
    expected = con.execute(registry.oracles()[name]).df()
    found = registry.queries()[name](spark, DIR).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
    assert len(found)
