"""Percentiles by ranges against Spark's own, on values of every kind."""

import pytest
from pyspark.sql import functions as F

from roomweave.operators import ranks

SHARES = (0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0)


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_percentiles(spark, monkeypatch, few):
    """Hot values, far outliers, both signs, groups of a few rows, null keys, nulls and NaN."""
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "RANGES", 16)
    k = F.col("id")
    rows = spark.range(0, 6_000, 1, 5).select(
        F.when(k % 10 == 0, F.lit(None)).otherwise(F.when(k < 5_000, "most").otherwise((k % 700).cast("string"))).alias("key"),
        F.when(k % 3 == 0, 7.0).when(k % 500 == 1, 1e308).when(k % 500 == 2, -1e308).when(k % 97 == 5, F.lit(None)).when(k % 97 == 6, float("nan")).otherwise(F.hash("id") / 7.0).alias("x"), (k % 11).alias("y"))
    names = {f"{c}{q}": (c, q) for c in "xy" for q in SHARES}
    clean = rows.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    for keys in ([], ["key"]):
        want = clean.groupBy(*keys).agg(*(F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in names.items()), F.count("y").alias("n"))
        got = ranks.percentiles(rows, names, keys, count="n")
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    nothing = ranks.percentiles(rows.limit(0), {"p": ("x", 0.5)}, count="n").collect()
    assert [tuple(r) for r in nothing] == [(None, 0)] and ranks.percentiles(rows.limit(0), {"p": ("x", 0.5)}, ["key"]).count() == 0


def test_many_values(spark):
    """Three million different values; no list of over FEW of them is made."""
    rows = spark.range(0, 3_000_000, 1, 8).select((F.xxhash64("id") / 3.0).alias("x"))
    names = {f"p{k}": ("x", q) for k, q in enumerate((0.02, 0.5, 0.98))}
    want = rows.agg(*(F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in names.items())).first()
    assert tuple(ranks.percentiles(rows, names).first()) == tuple(want)
