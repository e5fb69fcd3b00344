import __spark_entry__
from corpusloom.plans.oracle import ORACLE_SQL
from corpusloom.plans.queries import QUERIES


def test_names_agree():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)
