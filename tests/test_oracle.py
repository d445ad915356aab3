"""Every query with SQL gives the same rows as the SQL; every other query gives rows."""

import pytest
from conftest import rows_of

from lotweave.plans import formats, problems, reference, studies

#: Studies without SQL are tested by their parts in test_studies.py.
CASES = [(m, q) for m in (problems, reference, formats, studies) for q in m.QUERIES if m is not studies or q in m.SQL]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[q for _, q in CASES])
def test_query(spark, folder, duck, module, name):
    got = module.QUERIES[name](spark, folder).toPandas()
    if name in module.SQL:
        want = duck.execute(module.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    elif name != "p4_kept":
        assert len(got)


def test_entry(spark, folder):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
