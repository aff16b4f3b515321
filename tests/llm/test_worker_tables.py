"""What a worker keeps belongs to the operator that it serves."""

from functools import lru_cache

from holdfast.llm import common


def test_tables_go_when_another_operator_begins():
    made = []
    tables = common.worker_tables(lru_cache(maxsize=1)(lambda: made.append(1) or made))
    try:
        for operator in ("a", "a", "b", "b", "a"):
            common.begin(operator)
            tables()
        assert len(made) == 3
    finally:
        common._TABLES.pop()
