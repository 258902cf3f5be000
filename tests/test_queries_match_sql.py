"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import bindings
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
#: Nothing in the smallest tables meets these queries' conditions.
MAY_BE_EMPTY: set[str] = set()
bindings.load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, duck, name):
    frame = bindings.QUERIES[name](spark, FOLDER)
    if name in bindings.SQL:
        wrong = compare(frame, duck, bindings.SQL[name])
        assert wrong == "" or (wrong == "EMPTY RESULT" and name in MAY_BE_EMPTY)
    else:
        assert frame.count() > 0


def test_every_twin_has_a_query():
    assert set(bindings.SQL) <= set(bindings.QUERIES)
