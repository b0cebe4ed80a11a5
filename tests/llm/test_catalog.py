import re

from duelgrid.llm import catalog


def test_the_thirteen_operators_have_one_query_each():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(catalog.ORACLES) <= set(catalog.QUERIES)
