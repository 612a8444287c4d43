import re

import __spark_entry__ as entry


def test_one_query_for_each_operator():
    names = entry.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
