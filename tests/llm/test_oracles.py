"""The SQL twins of operators on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import duck, rows  # noqa: E402

from argusframe.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck(SF).sql(queries.ORACLES[name]).df())
