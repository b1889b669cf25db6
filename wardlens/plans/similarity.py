"""Similar-patient search and rule-based suggestions.

The reference builds a dense n x n cosine matrix in memory.  Here:

* features are z-scored with population statistics (one-row aggregate,
  attached as a scalar subquery);
* a query patient's vector is a one-row scalar subquery; every admission's
  cosine to it is Column arithmetic (no join, no pair emission) and the
  top-k is Spark's distributed ``orderBy().limit()`` (per-partition top-k,
  then a k-row merge) — linear in the data;
* suggestions are an array built with ``filter(array(when ...))``.

Neighbour lists of many admissions go through an index of cells
(``operators.neighbours``): lists of bounded length, not the full matrix,
whose size is quadratic in the number of admissions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.operators import neighbours as NB
from wardlens.session import cut_lineage
from wardlens.functions.columns import (SUGGEST_AIR, SUGGEST_DEFAULT, SUGGEST_GERIATRIC, SUGGEST_LONG_STAY,
                                        SUGGEST_REVIEW)

# Feature list: the reference uses age, gender, stay and three pollutants
# (PM2.5, NO2, O3); the fact table carries PM2.5, NO2 and SO2, so SO2 takes
# the place of O3.  Configurable per call.
SIM_FEATURES = ["age", "gender_code", "length_of_stay", "pm25", "no2", "so2"]


def sim_features(fact: DataFrame, features=SIM_FEATURES) -> DataFrame:
    """Gender M -> 0, F -> 1 (others NULL), death flag, complete rows only."""
    d = fact.select("admission_id", "mrd_no", "age",
                    F.when(F.col("gender") == "M", 0).when(F.col("gender") == "F", 1).alias("gender_code"),
                    "length_of_stay", "pm25", "no2", "so2",
                    F.col("is_mortality_case").cast("int").alias("mortality_flag"))
    return d.dropna(subset=list(features))


def zscore(d: DataFrame, features=SIM_FEATURES, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population sd per feature; a constant feature scores 0."""
    st = d.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                          for c in features]).alias("st")).scalar()
    out = {}
    for c in features:
        m, s = st.getField(c).getField("m"), st.getField(c).getField("s")
        out[c + suffix] = F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0))
    return d.withColumns(out)


def _norm(cols):
    return F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))


def top_similar(d: DataFrame, query_admission, k: int = 5, features=SIM_FEATURES) -> DataFrame:
    """Top-k admissions by cosine similarity to the admission
    ``query_admission`` (a literal or a scalar-subquery Column); the query
    row itself is excluded, an id that is not in the table has no neighbours, ties go to the smaller admission id.  Zero
    vectors have similarity 0, as in the reference's library."""
    zc = [c + "_z" for c in features]
    z = zscore(d, features).withColumn("__norm", _norm(zc))
    qid = query_admission if not isinstance(query_admission, (int, str)) else F.lit(query_admission)
    q = z.where(F.col("admission_id") == qid).select(
        F.struct(F.col("mrd_no").alias("mrd_no"), F.col("__norm").alias("norm"),
                 *[F.col(c).alias(c) for c in zc]).alias("q")).limit(1).scalar()
    dot = sum((F.col(c) * q.getField(c) for c in zc), F.lit(0.0))
    den = F.col("__norm") * q.getField("norm")
    score = F.when(den > 0, dot / den).otherwise(F.lit(0.0))
    cand = z.where((F.col("admission_id") != qid) & q.isNotNull()).withColumn("score", score)
    top = cand.orderBy(F.desc("score"), "admission_id").limit(k)
    # k rows: the rank window below runs on the k-row result only.
    w = Window.orderBy(F.desc("score"), "admission_id")
    return top.select(q.getField("mrd_no").alias("query_mrd_no"), F.row_number().over(w).alias("rank"),
                      "admission_id", "mrd_no", "age", "length_of_stay", "pm25", "mortality_flag", "score")


def neighbour_lists(d: DataFrame, k: int = 5, every: int = 20, features=SIM_FEATURES, exact: bool = True) -> DataFrame:
    """The ``k`` most similar admissions of each one whose id ``every`` divides, among all: ``(admission_id, rank, neighbour_id, score)``.

    Scores are rounded before they are compared; ties go to the smaller id.  An
    admission whose features are all average has no direction, so it has no
    neighbours and is none.
    """
    z = zscore(d, features)
    # Stored once: the index and the queries must see the same digits.
    rows = cut_lineage(z.select(F.col("admission_id").cast("bigint").alias("id"), NB.unit_vector([c + "_z" for c in features]).alias("v")))
    found = NB.neighbours(NB.build(rows, k), rows.where(F.col("id") % every == 0), k, exact=exact)
    return found.select(F.col("id").alias("admission_id"), "rank", F.col("neighbour").alias("neighbour_id"), "score")


def first_admission_of(d: DataFrame, mrd_no=None):
    """Scalar: the patient's first admission id (smallest id); with no
    patient given, the first admission of the table."""
    f = d if mrd_no is None else d.where(F.col("mrd_no") == mrd_no)
    return f.agg(F.min("admission_id")).scalar()


def suggestions(d: DataFrame, pm25_z: float = 1.5, long_stay: int = 10, elderly: int = 65) -> DataFrame:
    """Rule list per admission.  PM2.5 is tested on its z-score (as the
    reference applies the rule after scaling); stay and age on raw values."""
    z = zscore(d, ["pm25"])
    rules = F.array(
        F.when(F.col("pm25_z") > pm25_z, F.lit(SUGGEST_AIR)),
        F.when(F.col("length_of_stay") > long_stay, F.lit(SUGGEST_LONG_STAY)),
        F.when(F.col("age") > elderly, F.lit(SUGGEST_GERIATRIC)),
        F.when(F.col("mortality_flag") == 1, F.lit(SUGGEST_REVIEW)))
    s = F.filter(rules, lambda x: x.isNotNull())
    return z.select("admission_id", "mrd_no",
                    F.when(F.size(s) == 0, F.array(F.lit(SUGGEST_DEFAULT))).otherwise(s).alias("suggestions"))


def recommend(d: DataFrame, query_admission, k: int = 5) -> DataFrame:
    """Top-k similar admissions with their suggestions (k-row join)."""
    top = top_similar(d, query_admission, k)
    sug = suggestions(d).select("admission_id", "suggestions")
    # k rows: bounded broadcast.
    return sug.join(F.broadcast(top), "admission_id")
