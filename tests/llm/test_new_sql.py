"""Queries against their SQL twins."""

import pytest

from geoloom.llm import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_vector_codes"])
def test_query_equals_sql(name, spark, sf, duck):
    assert_same(queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE_SQL[name]))
