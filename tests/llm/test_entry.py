import pytest

from fleetlens.llm import entry
from .. import compare
from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_its_sql(spark, name):
    frame = entry.queries()[name](spark, SMALL)
    wanted, columns = compare.duck_rows(compare.connection(SMALL), entry.oracle_sql()[name])
    assert columns == sorted(frame.columns)
    assert compare.spark_rows(frame) == wanted


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.queries()) == list(range(1, 14))
