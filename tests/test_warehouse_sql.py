import datetime as dt
import tempfile

from conftest import SF_SMALL
from wardlens.plans import marts
from wardlens.plans.warehouse import insert_ignore
from wardlens.session import ensure_checkpoint_dir
from wardlens.sources.tables import load_fact


def test_sql_classify_risk_function(spark):
    marts.register_sql_functions(spark)
    got = spark.sql("SELECT classify_risk(20, false) a, classify_risk(NULL, true) b, classify_risk(8, NULL) c, "
                    "classify_risk(3, false) d").first()
    assert tuple(got) == ("High", "Critical", "Moderate", "Low")


def test_insert_ignore_keeps_existing_and_first_new(spark):
    target = spark.createDataFrame([("p1", 40, "M")], "mrd_no string, age int, gender string")
    incoming = spark.createDataFrame(
        [("p1", 99, "F", dt.date(2020, 1, 1), 1), ("p2", 50, "F", dt.date(2020, 2, 1), 3),
         ("p2", 51, "M", dt.date(2020, 1, 1), 9), ("p2", 52, "M", dt.date(2020, 1, 1), 2)],
        "mrd_no string, age int, gender string, doa date, sno int")
    out = insert_ignore(target, incoming.select("mrd_no", "age", "gender", "doa", "sno"), "mrd_no", ["doa", "sno"])
    got = {r.mrd_no: (r.age, r.gender) for r in out.collect()}
    assert got == {"p1": (40, "M"), "p2": (52, "M")}


def test_monthly_summary_procedure_is_idempotent(spark):
    path = tempfile.mkdtemp(prefix="wardlens-summary-", dir=ensure_checkpoint_dir(spark)) + "/t"
    fact = load_fact(spark, SF_SMALL)
    first = sorted(tuple(r) for r in marts.sp_generate_monthly_summary(fact, path).collect())
    second = sorted(tuple(r) for r in marts.sp_generate_monthly_summary(fact, path).collect())
    assert first == second and len(first) > 0
    assert len({r[0] for r in second}) == len(second)  # one row per month (the table's key)
