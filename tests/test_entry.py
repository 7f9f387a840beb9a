"""Driver contract and oracle parity of every registered query (sf0.001)."""
import pytest

import __spark_entry__ as E
from fundscope.plans.registry import entries
from tests.oracle_harness import compare

ENTRIES = entries()
ORACLE_NAMES = sorted(n for n, e in ENTRIES.items() if e.sql is not None)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "target_label" in df.columns


def test_contract_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    # the library's own registry has no training-data query; where they are installed, only those are added to it
    for name in ENTRIES:
        assert not name.startswith("op") and "pipeline" not in name
    for name in set(q) - set(ENTRIES):
        assert name.startswith("op") or name == "pipeline"


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_oracle_parity(spark, duck_small, small_dir, name):
    e = ENTRIES[name]
    r = compare(spark, duck_small, name, e.fn, e.sql, small_dir)
    assert r["status"] == "ok", r
