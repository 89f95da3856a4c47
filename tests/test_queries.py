"""Every registered query against its SQL, on the smallest tables."""
import pytest

import __spark_entry__ as entry
from compare import differences, duck

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
ORACLES = entry.oracle_sql()
# their SQL takes plain Newton steps, which 53 defaults are too few for
SELECTION = {"claimed_gini", "method_table", "selection_model", "selection_exclusion", "method_economics",
             "method_swap_profile"}


@pytest.fixture(scope="module")
def con():
    return {sf: duck(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(ORACLES, key=lambda n: (n in SELECTION, n)))
def test_matches_sql(spark, con, name):
    sf = LARGER if name in SELECTION else SF
    got = entry.queries()[name](spark, sf).toPandas()
    assert differences(got, con[sf].execute(ORACLES[name]).df()) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
