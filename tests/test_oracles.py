import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import SMALL, check  # noqa: E402

from epochloom import plans  # noqa: E402

QUERIES, SQL = plans.collect()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_rest_does_not_need_the_training_package():
    from pathlib import Path

    root = Path(plans.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "epochloom.llm" not in p.read_text(), p
