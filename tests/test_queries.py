import pytest

import __spark_entry__ as entry
from cuesmith.plans import captions, folds, records, streams
from oracle import compare
from conftest import SF

OWN = {**captions.ORACLES, **streams.ORACLES, **folds.ORACLES, **records.ORACLES}
ROWS = sorted(k for p in entry.PARTS for k in p.QUERIES if k not in OWN)


@pytest.mark.parametrize("name", sorted(OWN))
def test_against_sql(spark, name):
    compare(spark, name, SF)


@pytest.mark.parametrize("name", ROWS)
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
