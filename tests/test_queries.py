"""A sample of registered queries against their SQL; scripts/check_oracles.py runs all of them."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))

from check_oracles import TABLES, plain  # noqa: E402

from logwarden.oracles import ORACLES  # noqa: E402
from logwarden.queries import REGISTRY  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["stat_features", "stat_entropy", "net_features", "sessions", "events_per_hour", "new_destination", "zscore", "ensemble", "reasoning",
          "cooldown", "drift_report", "validate_schema", "parse_ts", "fill_median", "encode", "decode", "port_scans", "features", "jsonl_scan"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = REGISTRY[name](spark, SF)
    cols = sorted(df.columns)
    cur = db.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted([plain(row[names.index(c)]) for c in cols] for row in cur.fetchall())
    assert sorted([plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
