"""Exploratory data analysis as chart-data DataFrames (no plotting).

Every job is a distributed aggregate:

* histogram: one min/max pass, then a bin index per value and a count per
  (column, bin); bin edges follow numpy's rule (``linspace`` edges, last bin
  right-closed);
* KDE: values are first collapsed to (group, value, count); each distinct
  value then adds its kernel to a 200-point grid (generated per row, no
  join of grid x data); optional pre-binning bounds the work for
  continuous measures;
* box statistics: exact quartiles per group, whiskers = furthest points
  within 1.5 IQR, flier counts;
* correlation: every pairwise Pearson coefficient in one aggregate by pair
  (pairwise-complete rows, like pandas).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators import profile as P
from wardlens.operators.joins import join_small
from wardlens.operators.order_stats import percentiles_of_counts
from wardlens.session import cut_lineage

COLUMNS_BOUND = "one row per profiled column"
GROUPS_BOUND = "one row per curve or box of a chart"


def nulls_top(df: DataFrame, k: int = 10) -> DataFrame:
    """Columns with the most NULLs (ties by name), top ``k``."""
    return (P.null_summary(df).select("column_name", "null_count")
            .orderBy(F.desc("null_count"), "column_name").limit(k))


def duplicates(df: DataFrame) -> DataFrame:
    return P.duplicate_rows(df)


def _cells(df: DataFrame, cols) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(F.explode(arr).alias("s")).select("s.column_name", "s.x").where(F.col("x").isNotNull())


def histogram(df: DataFrame, cols, bins: int = 30) -> DataFrame:
    """(column_name, bin, bin_lo, bin_hi, count) for ``bins`` equal-width bins
    over [min, max]; empty bins are reported with count 0."""
    cells = _cells(df, cols)
    st = cells.groupBy("column_name").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    same = F.col("mn") == F.col("mx")
    st = st.select("column_name",
                   F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                   F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins

    def edge(i):
        return F.when(i >= bins, F.col("hi")).otherwise(i * step + F.col("lo"))

    j = join_small(cells, st, "column_name", bound=COLUMNS_BOUND)
    i0 = F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int")
    j = j.withColumn("i0", F.least(F.greatest(i0, F.lit(0)), F.lit(bins - 1)))
    i1 = F.when(F.col("x") < edge(F.col("i0")), F.col("i0") - 1).otherwise(F.col("i0"))
    j = j.withColumn("i1", i1)
    i2 = F.when((F.col("x") >= edge(F.col("i1") + 1)) & (F.col("i1") != bins - 1), F.col("i1") + 1) \
          .otherwise(F.col("i1"))
    counts = j.groupBy("column_name", i2.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = st.select("column_name", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, ["column_name", "bin"], "left")
    return out.select("column_name", "bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def kde(df: DataFrame, value: str, by: str | None = None, gridsize: int = 200, cut: float = 3.0,
        common_norm: bool = True, prebin: int | None = None) -> DataFrame:
    """Gaussian KDE curves (Scott bandwidth ``sd * n^(-1/5)``) on a grid from
    ``min - cut*bw`` to ``max + cut*bw``; with ``by`` each curve is scaled by
    its group's share of all rows (``common_norm``).

    ``prebin``: collapse values onto that many equal-width bins first (the
    usual binned-KDE approximation) so the work no longer grows with the
    number of distinct values.
    """
    g = F.col(by).cast("string") if by else F.lit("all")
    base = df.where(F.col(value).isNotNull()).select(g.alias("grp"), F.col(value).cast("double").alias("v"))
    if by:
        base = base.where(F.col("grp").isNotNull())
    st = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                                 F.min("v").alias("mn"), F.max("v").alias("mx"))
    total = base.agg(F.count(F.lit(1))).scalar()
    st = st.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    st = st.withColumns({"lo": F.col("mn") - cut * F.col("bw"), "hi": F.col("mx") + cut * F.col("bw")})
    vals = base
    if prebin:
        w = (F.col("mx") - F.col("mn")) / prebin
        vals = join_small(base, st.select("grp", "mn", "mx"), "grp", bound=GROUPS_BOUND).withColumn(
            "v", F.when(F.col("mx") > F.col("mn"),
                        F.col("mn") + (F.least(F.floor((F.col("v") - F.col("mn")) / w), F.lit(prebin - 1)) + 0.5) * w)
            .otherwise(F.col("v"))).select("grp", "v")
    vc = vals.groupBy("grp", "v").agg(F.count(F.lit(1)).alias("cnt"))
    j = join_small(vc, st.select("grp", "n", "bw", "lo", "hi"), "grp", bound=GROUPS_BOUND)
    j = j.where(F.col("bw") > 0)
    step = (F.col("hi") - F.col("lo")) / (gridsize - 1)
    e = j.select("grp", "n", "bw", "lo", "hi", "v", "cnt",
                 F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("i"))
    e = e.withColumn("x", F.col("lo") + F.col("i") * step)
    u = (F.col("x") - F.col("v")) / F.col("bw")
    contrib = F.col("cnt") * F.exp(F.lit(-0.5) * u * u)
    s = e.groupBy("grp", "i", "x", "n", "bw").agg(F.sum(contrib).alias("ksum"))
    denom = (F.lit(float(1)) * (total if common_norm else F.col("n"))) * F.col("bw") * math.sqrt(2 * math.pi)
    return s.select(F.col("grp").alias("curve"), F.col("i").alias("grid_index"), "x",
                    (F.col("ksum") / denom).alias("density"))


def box_stats(df: DataFrame, value: str, by: str, whis: float = 1.5) -> DataFrame:
    """Box-plot statistics per group (quartiles by linear interpolation), all from the counts of the distinct values."""
    d = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    counts = cut_lineage(d.groupBy(by, F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("cnt")))
    q = counts.groupBy(by).agg(F.sum("cnt").alias("n")).join(
        percentiles_of_counts(counts, [by], {"q1": 0.25, "median": 0.5, "q3": 0.75}), by).withColumn("iqr", F.col("q3") - F.col("q1"))
    j = join_small(counts.withColumnRenamed("value", "v"), q, by, bound=GROUPS_BOUND)
    lo_lim = F.col("q1") - whis * F.col("iqr")
    hi_lim = F.col("q3") + whis * F.col("iqr")
    w = j.groupBy(by, "n", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("v") >= lo_lim, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= hi_lim, F.col("v"))).alias("whisker_hi"),
        F.sum(F.when((F.col("v") < lo_lim) | (F.col("v") > hi_lim), F.col("cnt")).otherwise(0)).alias("n_fliers"))
    return w


def correlation_matrix(df: DataFrame, cols=None, exclude=("sno",)) -> DataFrame:
    """(col_a, col_b, corr) for every ordered pair of numeric columns.

    Each row gives its value pairs, which are summed up per pair of columns
    before the shuffle: one aggregate, whatever the number of columns."""
    cols = cols or P.numeric_columns(df, exclude=exclude)
    values = F.array(*[F.col(c).cast("double") for c in cols])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    d = df.select(values.alias("v")).select("v", F.explode(own).alias("p")).select("p", F.col("v")[F.col("p.i")].alias("x"), F.col("v")[F.col("p.j")].alias("y"))
    r = d.groupBy("p").agg(F.corr("x", "y").alias("corr"))
    names = F.array(*[F.lit(c) for c in cols])
    a, b = names[F.col("p.i")], names[F.col("p.j")]
    both = r.select("corr", F.explode(F.array(F.struct(a.alias("col_a"), b.alias("col_b")), F.struct(b.alias("col_a"), a.alias("col_b")))).alias("s"))
    same = df.sparkSession.range(1).select(F.explode(names).alias("col_a")).select("col_a", F.col("col_a").alias("col_b"), F.lit(1.0).alias("corr"))
    return both.select("s.col_a", "s.col_b", "corr").unionByName(same)


def category_counts(df: DataFrame, cols) -> DataFrame:
    return P.value_counts(df, cols)


def repeat_patients(df: DataFrame, key: str = "mrd_no") -> DataFrame:
    """Patients with more than one admission, most frequent first."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("admissions"))
            .where(F.col("admissions") > 1).orderBy(F.desc("admissions"), key))
