"""Every registered query against its SQL on the smallest tables; those without SQL must run and give rows."""

import pytest
from conftest import SMALL
from oracle import differences

from larkspur.plans.all import REGISTRY

#: Queries that find nothing in the smallest tables.
EMPTY = {"demotions"}


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_equals_sql(spark, name):
    said = differences(spark, REGISTRY[name].run, REGISTRY[name].sql, SMALL)
    assert said == ("no rows" if name in EMPTY else ""), said


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_gives_rows(spark, name):
    assert not REGISTRY[name].run(spark, SMALL).isEmpty()


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "larkspur"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "larkspur.llm" not in p.read_text(), p
