"""Column-level building blocks (all JVM-side expressions, no Python UDFs).

Each function takes and returns ``Column`` objects so it composes inside
``select``/``withColumn``/``agg`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Age bucket edges (left-closed) and labels, in order:
AGE_EDGES = [0, 18, 40, 60, 80, 200]
AGE_LABELS = ["0-18", "19-40", "41-60", "61-80", "80+"]
# PM2.5 bands (lower bounds, inclusive), highest first:
PM25_BANDS = [(150, "Hazardous"), (100, "Severe"), (60, "High")]
PM25_DEFAULT_BAND = "Normal"
# Patient-risk classification thresholds (days): >=15 High, 7..14 Moderate.
# Interventions text, in rule order:
SUGGEST_AIR = "Air purifier recommended / transfer to cleaner ward"
SUGGEST_LONG_STAY = "Flag for long-stay review and infection monitoring"
SUGGEST_GERIATRIC = "Geriatric support plan initiation"
SUGGEST_REVIEW = "Retrospective review for critical event prevention"
SUGGEST_DEFAULT = "Maintain standard monitoring and care"
# ---------------------------------------------------------------------------


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age_bucket(age) -> Column:
    """Left-closed bins [0,18) [18,40) [40,60) [60,80) [80,200); outside -> NULL."""
    a = c(age)
    expr = None
    for lo, hi, label in zip(AGE_EDGES[:-1], AGE_EDGES[1:], AGE_LABELS):
        cond = (a >= lo) & (a < hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(F.lit(None).cast("string"))


def pm25_band(pm25, null_label: str | None = None) -> Column:
    """PM2.5 band by the ordered thresholds; NULL reading -> ``null_label``."""
    p = c(pm25)
    expr = F.when(p.isNull(), F.lit(null_label).cast("string"))
    for lo, label in PM25_BANDS:
        expr = expr.when(p >= lo, label)
    return expr.otherwise(PM25_DEFAULT_BAND)


def classify_risk(length_of_stay, is_mortality) -> Column:
    """Patient risk class: died -> Critical; LOS >=15 High; 7..14 Moderate; else Low.

    A NULL death flag falls through to the LOS tests; a NULL LOS ends in Low.
    """
    los, died = c(length_of_stay), c(is_mortality)
    return (F.when(died, "Critical")
            .when(los >= 15, "High")
            .when(los.between(7, 14), "Moderate")
            .otherwise("Low"))


def pct(k, n, digits: int = 2) -> Column:
    """``ROUND(100.0 * k / n, digits)`` with a double literal (not DECIMAL)."""
    return F.round(F.lit(100.0) * c(k) / c(n), digits)


def safe_double(x) -> Column:
    """Text -> double; blanks, junk and thousands separators become NULL."""
    return F.trim(c(x).cast("string")).try_cast("double")


def is_death_outcome(outcome) -> Column:
    """Case-insensitive 'death' substring test; NULL outcome -> FALSE."""
    return F.coalesce(F.lower(c(outcome)).contains("death"), F.lit(False))


def death_flag_exact(outcome) -> Column:
    """1 when upper(outcome) == 'DEATH' else 0 (NULL -> 0)."""
    return F.when(F.upper(c(outcome)) == "DEATH", 1).otherwise(0)


_NON_WORD = re.compile(r"[^\w\s]")


def normalize_name(name: str) -> str:
    """strip -> lower -> ' '->'_' -> drop non-word characters (in that order)."""
    return _NON_WORD.sub("", name.strip().lower().replace(" ", "_"))


def left_chars(x, n: int) -> Column:
    """VARCHAR(n) cast semantics: truncate to ``n`` characters."""
    return F.substring(c(x), 1, n)


def iso_week_start(d) -> Column:
    return F.date_trunc("week", c(d)).cast("date")


def month_start(d) -> Column:
    return F.trunc(c(d), "month")
