import pytest
import sqlcompare
from strandline.plans import oracle
from strandline.plans.queries import QUERIES

SQL = oracle.oracle_sql()
#: Those whose SQL takes long to compile are left to the entry module's own comparison.
SLOW = {"extract_accession", "annotate_headers"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, name):
    sqlcompare.check(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001")
