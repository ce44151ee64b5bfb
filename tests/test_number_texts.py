"""Numbers in texts are written as printf writes them."""

from pyspark.sql import functions as F

from filingmill.operators import series


def test_two_decimals_as_printf(spark):
    values = [-0.0027, 0.0027, -0.0, 0.0, 0.125, -0.375, 1.005, 1.015, 2.675, -99.995, 1005.909, 123456789.125]
    values += [k / n * 100 for n in (8, 40, 4000, 20000) for k in (-3, 1, 5, 7, 201)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", series.two_decimals(F.col("v")).alias("plain"), series.signed_pct(F.col("v")).alias("signed")).collect()
    assert [(r.plain, r.signed) for r in rows] == [(f"{r.v:.2f}", f"{r.v:+.2f}%") for r in rows]
    assert spark.range(1).select(series.signed_pct(F.lit(None).cast("double"))).first()[0] is None
