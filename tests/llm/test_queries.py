import pytest
import sqlcompare
from strandline.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    sqlcompare.check(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_every_operator_has_one_query():
    names = sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op"))
    assert names == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_covers_its_whole_table(spark, name):
    table = "pages" if name.startswith("op5_") else "conversations" if name == "instruction_packing" else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    found = registry.queries()[name](spark, SF)
    if name.startswith("op11_"):  # a report of each language
        assert found.select("lang").distinct().count() <= found.count() < n
    elif name == "instruction_packing":
        assert found.where("start = 0").count() == n
    elif name.startswith("op1_"):
        assert found.select("doc_id").distinct().count() == n
    else:
        assert found.count() == (2 * n if name.startswith("op5_") else n)
