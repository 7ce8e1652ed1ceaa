"""Exact percentiles of groups that are larger than a part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import score


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_a_group_may_lie_in_many_parts(spark, coalesced):
    rng = np.random.default_rng(5)
    groups = {"large": rng.integers(0, 4000, 9000) / 8, "equal": np.full(500, 2.5), "one": np.array([7.0]), None: rng.normal(size=300), "": np.array([-1.0, 3.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("one", None)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("clash"))
        got = {r.g: r for r in score.percentiles(df, "g", "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got.keys() == {*groups, "none"}
    for g, values in groups.items():
        r = got[g]
        assert r.n == len(values)
        assert np.allclose([r.p50, r.p95, r.p99], np.percentile(values, [50, 95, 99]), atol=1e-6)
    assert (got["none"].p50, got["none"].p99, got["none"].n) == (None, None, 0)


def test_no_rows(spark):
    assert score.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v").collect() == []
