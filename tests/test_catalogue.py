"""Every query of the engine against its SQL."""

import pytest

from kinfold.plans.catalogue import ORACLE_SQL, QUERIES
from oracle import compare

MAY_BE_EMPTY = {"low_cardinality", "shared_token_pairs"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    n = compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)
    assert n or name in MAY_BE_EMPTY


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLE_SQL) <= {"double_metaphone_tokens"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
