"""File sources and sinks: typed CSV ingest, header normalisation, safe
coercion, Parquet/CSV sinks.

CSV is read with an explicit schema (no inference on the hot path) in
PERMISSIVE mode; malformed rows keep their raw text in a corrupt-record
column instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.columns import normalize_name

# The 57 columns of the staging table, in order (dirty lab values stay text).
STAGING_COLUMNS = [
    ("sno", "long"),
    ("mrd_no", "string"),
    ("doa", "date"),
    ("dod", "date"),
    ("age", "int"),
    ("gender", "string"),
    ("rural", "string"),
    ("type_of_admissionemergencyopd", "string"),
    ("month_year", "string"),
    ("duration_of_stay", "int"),
    ("duration_of_intensive_unit_stay", "int"),
    ("outcome", "string"),
    ("smoking", "int"),
    ("alcohol", "int"),
    ("dm", "int"),
    ("htn", "int"),
    ("cad", "int"),
    ("prior_cmp", "int"),
    ("ckd", "int"),
    ("hb", "string"),
    ("tlc", "string"),
    ("platelets", "string"),
    ("glucose", "string"),
    ("urea", "string"),
    ("creatinine", "string"),
    ("bnp", "string"),
    ("raised_cardiac_enzymes", "int"),
    ("ef", "string"),
    ("severe_anaemia", "int"),
    ("anaemia", "int"),
    ("stable_angina", "int"),
    ("acs", "int"),
    ("stemi", "int"),
    ("atypical_chest_pain", "int"),
    ("heart_failure", "int"),
    ("hfref", "int"),
    ("hfnef", "int"),
    ("valvular", "int"),
    ("chb", "int"),
    ("sss", "int"),
    ("aki", "int"),
    ("cva_infract", "int"),
    ("cva_bleed", "int"),
    ("af", "int"),
    ("vt", "int"),
    ("psvt", "int"),
    ("congenital", "int"),
    ("uti", "int"),
    ("neuro_cardiogenic_syncope", "int"),
    ("orthostatic", "int"),
    ("infective_endocarditis", "int"),
    ("dvt", "int"),
    ("cardiogenic_shock", "int"),
    ("shock", "int"),
    ("pulmonary_embolism", "int"),
    ("chest_infection", "string"),
    ("age_bucket", "string"),
]
_STAGING_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "date": T.DateType(), "string": T.StringType()}
STAGING_SCHEMA = T.StructType([T.StructField(n, _STAGING_TYPES[t]) for n, t in STAGING_COLUMNS])

BROUGHT_DEAD_SCHEMA = T.StructType([
    T.StructField("sno", T.IntegerType()), T.StructField("mrd", T.StringType()),
    T.StructField("age", T.IntegerType()), T.StructField("gender", T.StringType()),
    T.StructField("ruralurban", T.StringType()), T.StructField("date_of_brought_dead", T.StringType())])


def normalize_columns(df: DataFrame) -> DataFrame:
    """Apply the header rule to every column; refuse silent collisions."""
    new = [normalize_name(c) for c in df.columns]
    dup = {n for n in new if new.count(n) > 1}
    if dup:
        raise ValueError(f"column names collide after normalisation: {sorted(dup)}")
    return df.toDF(*new)


NULL_TOKEN = "\\N"


def read_csv_text(spark: SparkSession, path: str, corrupt_col: str | None = None,
                  null_value: str | None = None) -> DataFrame:
    """Header CSV, every column as text, names normalised (no inference).

    ``null_value``: the token that marks NULL (our own sink writes ``\\N`` so
    that empty strings survive a round trip)."""
    opts = {"header": "true", "mode": "PERMISSIVE", "inferSchema": "false"}
    if null_value is not None:
        opts["nullValue"] = null_value
    if corrupt_col:
        opts["columnNameOfCorruptRecord"] = corrupt_col
    return normalize_columns(spark.read.options(**opts).csv(path))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, date_format: str = "yyyy-MM-dd",
                   corrupt_col: str | None = None) -> DataFrame:
    """Header CSV with an explicit schema (positional), PERMISSIVE."""
    sch = schema
    opts = {"header": "true", "mode": "PERMISSIVE", "dateFormat": date_format, "enforceSchema": "true"}
    if corrupt_col:
        sch = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType())])
        opts["columnNameOfCorruptRecord"] = corrupt_col
    return spark.read.options(**opts).schema(sch).csv(path)


def coerce_dates(df: DataFrame, cols, fmt: str | None = None) -> DataFrame:
    """Safe date parsing for each listed column that exists (bad -> NULL)."""
    present = [c for c in cols if c in df.columns]
    conv = {}
    for c in present:
        if dict(df.dtypes)[c] in ("date",):
            continue
        x = F.trim(F.col(c).cast("string"))
        conv[c] = F.try_to_date(x, fmt) if fmt else F.try_to_date(x)
    return df.withColumns(conv) if conv else df


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    """Safe numeric coercion (to double) for each listed column that exists."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.trim(F.col(c).cast("string")).try_cast("double") for c in present}) \
        if present else df


def read_brought_dead(spark: SparkSession, path: str) -> DataFrame:
    """Brought-dead register: BOM/space-padded headers, padded codes,
    unpadded M/d/yyyy dates.  Returns typed, trimmed columns."""
    raw = read_csv_text(spark, path)
    return raw.select(
        F.col("sno").try_cast("int").alias("sno"),
        F.trim("mrd").alias("mrd"),
        F.trim("age").try_cast("int").alias("age"),
        F.trim("gender").alias("gender"),
        F.trim("ruralurban").alias("ruralurban"),
        F.try_to_date(F.trim("date_of_brought_dead"), "M/d/yyyy").alias("date_of_brought_dead"))


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV that keeps padding and tells NULL apart from ''."""
    (df.write.mode(mode).option("header", "true").option("ignoreLeadingWhiteSpace", "false")
       .option("ignoreTrailingWhiteSpace", "false").option("nullValue", NULL_TOKEN).csv(path))


def export_columns(df: DataFrame, wanted) -> DataFrame:
    """Keep the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])
