"""Key rules and their violations."""

import pytest
from conftest import as_set

from tidemark.operators.constraints import Reference, Unique, violation_totals, violations


@pytest.fixture
def parent(rows):
    return rows("id int, name string, n int", (1, "a", 0), (2, "b", 0), (2, "c", 0), (None, "a", 0), (None, "d", 0))


def test_unique(parent):
    found = violations(Unique("ids", parent, ("id",)), Unique("names", parent, ("name",)))
    assert as_set(found) == [("ids", "doubled", "2", 2), ("ids", "null", "NULL", 2), ("names", "doubled", "a", 2)]
    assert violations(Unique("ids", parent, ("id",), nullable=True)).count() == 1


def test_unique_of_two_columns(parent):
    assert violations(Unique("both", parent, ("id", "name"), nullable=True)).count() == 0
    nulls = violations(Unique("both", parent, ("id", "name")))
    assert as_set(nulls) == [("both", "null", "NULL, a", 1), ("both", "null", "NULL, d", 1)]


def test_reference(rows, parent):
    child = rows("owner int, v int", (1, 0), (3, 0), (3, 1), (None, 0))
    found = violations(Reference("owners", child, ("owner",), parent, ("id",)))
    assert as_set(found) == [("owners", "missing", "3", 2)]
    strict = Reference("owners", child, ("owner",), parent, ("id",), nullable=False)
    assert as_set(violation_totals(strict)) == [("owners", "missing", 1, 2), ("owners", "null", 1, 1)]


def test_nothing_to_report(rows, parent):
    good = rows("id int", (1,), (2,))
    empty = good.limit(0)
    assert violations(Unique("ids", good, ("id",)), Reference("r", good, ("id",), parent, ("id",))).count() == 0
    assert violations(Unique("ids", empty, ("id",)), Reference("r", empty, ("id",), empty, ("id",))).count() == 0
    assert violations(Reference("r", good, ("id",), empty, ("id",))).count() == 2


def test_rows_are_counted_before_they_are_shuffled(parent):
    plan = violations(Unique("ids", parent, ("id",)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
