"""The queries of the subpackage against their SQL, over the smallest tables, with code generation on."""

import pytest

from plumbline.llm import queries
from tests.test_queries import DATA, db, generated, value  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(generated, db, name):  # noqa: F811
    df = queries.QUERIES[name](generated, DATA)
    names = sorted(df.columns)
    got = sorted(repr(tuple(value(r[c]) for c in names)) for r in df.collect())
    if name in queries.SQL:
        r = db.execute(queries.SQL[name])
        at = [x[0] for x in r.description]
        assert sorted(at) == names
        assert got == sorted(repr(tuple(value(row[at.index(c)]) for c in names)) for row in r.fetchall())
