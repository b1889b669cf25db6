import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlens.operators.ranks import value_ranks
from wardlens.operators.sequence import dense_rank_within, lag_within

D = dt.date


def _gaps(spark):
    rows = [  # overlap, gaps of 30 and 31, NULL discharge, two admissions on one day
        (1, "p1", D(2020, 1, 1), D(2020, 1, 10)), (2, "p1", D(2020, 1, 5), D(2020, 1, 8)),
        (3, "p1", D(2020, 2, 7), D(2020, 2, 9)), (4, "p1", D(2020, 3, 11), None),
        (5, "p1", D(2020, 3, 11), D(2020, 3, 12)), (6, "p2", D(2020, 1, 1), D(2020, 1, 2)),
        (7, "p2", D(2020, 2, 1), D(2020, 2, 3)), (8, "p3", D(2020, 5, 5), D(2020, 5, 6))]
    return spark.createDataFrame(rows, "admission_id long, mrd_no string, doa date, dod date")


def test_lag_within_equals_plain_window(spark):
    df = _gaps(spark)
    w = Window.partitionBy("mrd_no").orderBy("doa", "admission_id")
    ref = {r.admission_id: r.prev for r in df.select("admission_id", F.lag("dod").over(w).alias("prev")).collect()}
    got = {r.admission_id: r.prev for r in lag_within(df, "mrd_no", "doa", "admission_id", "dod", "prev").collect()}
    assert got == ref


def test_dense_rank_within_equals_plain_window(spark):
    df = _gaps(spark)
    w = Window.partitionBy("mrd_no").orderBy("doa")
    ref = {r.admission_id: r.s for r in df.select("admission_id", F.dense_rank().over(w).alias("s")).collect()}
    got = {r.admission_id: r.s for r in dense_rank_within(df, "mrd_no", "doa", "s").collect()}
    assert got == ref


def test_average_ranks_with_ties(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
    got = {r.v: r["rank"] for r in value_ranks(df, "v", partitions=3).collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 5.0, 10.0: 7.0}
    n = len(vals)
    assert sum(got[v] for v in vals) == n * (n + 1) / 2
