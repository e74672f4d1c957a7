"""Every registered job with a SQL oracle must give the oracle's rows on
sf0.001 (same column names, order-insensitive values); jobs without an
oracle must at least run. Jobs on one stored run share it, so the model jobs
take their turn too."""

import math

import pytest

from quarry.plans.catalog import load_all

REG = load_all()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.mark.parametrize("key", sorted(REG))
def test_job_matches_oracle(spark, duck, key):
    from conftest import SMALL
    e = REG[key]
    sdf = e.job(spark, SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    if e.sql is None:
        return
    cur = duck.execute(e.sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows(sdf.columns, srows) == rows(dcols, cur.fetchall())
