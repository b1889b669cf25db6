from pyspark.sql import functions as F

from wardlens.functions.columns import age_bucket, classify_risk, normalize_name, pm25_band, safe_double


def test_age_bucket_edges(spark):
    ages = [0, 17, 18, 39, 40, 59, 60, 79, 80, 199, 200, -1, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    got = [r[0] for r in df.select(age_bucket("age")).collect()]
    assert got == ["0-18", "0-18", "19-40", "19-40", "41-60", "41-60", "61-80", "61-80", "80+", "80+",
                   None, None, None]


def test_pm25_bands_and_unknown(spark):
    df = spark.createDataFrame([(v,) for v in [None, 59.99, 60.0, 99.9, 100.0, 149.99, 150.0]], "pm25 double")
    got = [r[0] for r in df.select(pm25_band("pm25", "Unknown")).collect()]
    assert got == ["Unknown", "Normal", "High", "High", "Severe", "Severe", "Hazardous"]


def test_classify_risk_null_semantics(spark):
    rows = [(None, True), (20, False), (15, None), (14, False), (7, False), (6, False), (None, None)]
    df = spark.createDataFrame(rows, "los int, died boolean")
    got = [r[0] for r in df.select(classify_risk("los", "died")).collect()]
    assert got == ["Critical", "High", "High", "Moderate", "Moderate", "Low", "Low"]


def test_dirty_labs_coerce_to_null(spark):
    df = spark.createDataFrame([(v,) for v in ["", " 12.5 ", "EMPTY", "1,200", None, "7"]], "v string")
    got = [r[0] for r in df.select(safe_double("v")).collect()]
    assert got == [None, 12.5, None, None, None, 7.0]


def test_header_normaliser():
    assert normalize_name("\ufeffS.NO") == "sno"
    assert normalize_name("GENDER ") == "gender"
    assert normalize_name("RURAL/URBAN") == "ruralurban"
    assert normalize_name("DATE OF BROUGHT DEAD") == "date_of_brought_dead"
    assert normalize_name("PM2.5") == "pm25"
