"""Every registered query against its SQL on the smallest tables."""

import pytest

from conftest import SF
from sightline.plans.catalog import ORACLES, QUERIES
from sightline.plans.compare import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_names_are_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100


#: The smallest tables have 17 identities, of which these sample 20.
SHORT = {"w15_balanced_sample", "a22_sampling_summary"}


@pytest.mark.parametrize("name", sorted(SHORT))
def test_a_short_sample_is_an_error(spark, name):
    with pytest.raises(ValueError, match="identities have 4 valid images, 20 are wanted"):
        QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SHORT))
def test_query(spark, duck, name):
    status, detail = compare(spark, SF, name, QUERIES, ORACLES, duck)
    assert status == ("same" if name in ORACLES else "rows"), detail
