import pytest

from crestline.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    q = duck(FOLDER).execute(ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in q.fetchall()), key=repr)
    assert got == want
