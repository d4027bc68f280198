"""Moments of sparse counts over as many samples as the table has."""

import os

import pytest

from tallgrass.operators import cells as ce
from tallgrass.plans import base, learning  # noqa: F401  (it registers the queries)

DATA = "/root/testdata/sf0.001"


def test_moments_count_the_samples(spark):
    counts = spark.createDataFrame([("s1", "f", 2.0), ("s2", "f", 4.0), ("s3", "g", 3.0)], "sample string, feature string, value double")
    got = {r["feature"]: (r["mean"], r["var"]) for r in ce.sparse_moments(counts, cell="sample").collect()}
    assert got == {"f": (pytest.approx(2.0), pytest.approx(8 / 3)), "g": (pytest.approx(1.0), pytest.approx(2.0))}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_variances_on_test_data(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    full = f"WITH {base.MATRIX} SELECT feature, avg(coalesce(value, 0)), var_pop(coalesce(value, 0)) FROM (SELECT DISTINCT sample FROM m) CROSS JOIN (SELECT DISTINCT feature FROM m) LEFT JOIN m USING (sample, feature) GROUP BY 1"
    want = {f: (mean, var) for f, mean, var in con.execute(full).fetchall()}
    got = base.QUERIES["hvg_variance"](spark, DATA).collect()
    assert sorted((r["var"] for r in got), reverse=True) == [pytest.approx(v, abs=0.02) for v in sorted((v for _, v in want.values()), reverse=True)[:10]]
    assert all(r["mean"] == pytest.approx(want[r["feature"]][0], abs=1e-4) for r in got)
    binned = base.QUERIES["hvg_binned_dispersion"](spark, DATA).collect()
    assert len(binned) == len(want)
    assert all(r["dispersion"] == pytest.approx(want[r["feature"]][1] / want[r["feature"]][0], rel=1e-3, abs=1e-3) for r in binned)
