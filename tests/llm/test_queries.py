import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import SMALL, check  # noqa: E402

from epochloom.llm import queries as Q  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, Q.QUERIES[name], Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_rows_are_distinct(spark, name):
    x = Q.QUERIES[name](spark, SMALL)
    assert x.count() == x.distinct().count()


def test_related_records_share_a_split(spark):
    from pyspark.sql import functions as F

    x = Q.p2_splits(spark, SMALL)
    assert x.groupBy("pid_min").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
