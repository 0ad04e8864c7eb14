"""Registered queries against their SQL oracles on the smallest tables."""

import pytest

import __spark_entry__ as contract
from oracle_check import connect, duck_rows, plain, spark_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
# those of tomeweave.llm have their tests in tests/llm
LLM = set(contract.llm.QUERIES) if contract.llm else set()
OWN = [n for n in QUERIES if n in ORACLES and n not in LLM and n != "pipeline"]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_oracle(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duck_rows(connect(FOLDER), ORACLES[name])


def test_entry_is_a_plain_table(spark):
    assert contract.entry(spark).columns == ["isbn13", "row", "label"]
    assert plain(1.0) == "1"
