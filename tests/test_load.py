"""Loading the warehouse again, broken loads, schema differences, ingest with rejects, refreshed summaries."""

import datetime as dt
import uuid

import pytest

from wardlens.plans import load as L, marts
from wardlens.session import ensure_checkpoint_dir
from wardlens.sources.tables import load_fact, load_master

SF = "/root/testdata/sf0.001"


def _database(spark):
    name = f"wh_{uuid.uuid4().hex[:8]}"
    L.create(spark, name, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    return name


def _rows(spark, db):
    return {t: sorted(map(str, spark.table(f"{db}.{t}").collect())) for t in L.TABLES}


def test_loads_are_the_same_again_and_after_a_break(spark):
    staging, db = load_master(spark, SF), _database(spark)
    L.load(staging, db)
    once = _rows(spark, db)
    assert len(once["fact_admissions"]) == staging.count() and "Unknown" in once["dim_pollution"][0]
    L.create(spark, db)
    L.load(staging, db)
    assert _rows(spark, db) == once
    # A load that broke after two of the dimensions, then in the midst of the fact.
    broken = _database(spark)
    L._insert_missing(L.dim_patient(staging), broken, "dim_patient")
    L._insert_missing(L.dim_department(staging), broken, "dim_department")
    L.load(staging.where("sno % 3 = 0"), broken)
    L.load(staging, broken)
    assert _rows(spark, broken) == once
    L.reset(spark, db)
    assert not [t for t in spark.catalog.listTables(db) if not t.isTemporary]
    L.reset(spark, db)


def test_first_batch_wins_and_null_keys_stay_out(spark):
    db = _database(spark)
    a = spark.createDataFrame([("p1", 40, "M"), (None, 1, "F")], "mrd_no string, age int, gender string")
    L._insert_missing(a, db, "dim_patient")
    L._insert_missing(spark.createDataFrame([("p1", 99, "F"), ("p2", 5, None)], a.schema), db, "dim_patient")
    assert sorted(tuple(r) for r in spark.table(f"{db}.dim_patient").collect()) == [("p1", 40, "M"), ("p2", 5, None)]


def test_schema_differences(spark):
    a = spark.createDataFrame([], "id bigint, Name string, gone int")
    b = spark.createDataFrame([], "ID bigint, name int, fresh date")
    got = {r.column_name: r.status for r in L.schema_differences(a, b).collect()}
    assert got == {"id": "ok", "name": "type", "gone": "missing", "fresh": "unexpected"}


def test_ingest(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,a,2020-01-02,5\n2,b,2020-13-02,5\n3,,2020-01-02,x\n4,d,,\n5,e,2020-01-02,5,more\n6\n,f,2020-01-02, 7 \n")
    types = {"sno": "bigint", "name": "string", "day": "date", "age": "int"}
    raw = spark.read.schema("sno string, name string, day string, age string, corrupt_record string").options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=L.CORRUPT).csv(str(tmp_path / "x.csv"))
    rows = L.checked(raw.cache(), types, ["sno", "name"])
    assert [tuple(r) for r in L.accepted(rows, types).orderBy("sno").collect()] == [(1, "a", dt.date(2020, 1, 2), 5), (4, "d", None, None)]
    got = {r.sno: r.reasons for r in L.rejected(rows, types).collect()}
    assert got == {"2": "date: day", "3": "int: age; missing: name", "5": "line", "6": "line; missing: name", None: "missing: sno"}


@pytest.mark.parametrize("order", [("a", "b"), ("b", "a", "b"), ("a", "a", "b", "a")])
def test_refreshed_summaries_in_any_order(spark, order):
    fact = load_fact(spark, SF)
    batches = {"a": fact.where("admission_id % 3 = 0"), "b": fact.where("admission_id % 3 <> 0")}
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sums-{uuid.uuid4().hex[:8]}"
    for b in order:
        L.refresh(batches[b], ["department"], b, path)
        L.refresh(batches[b], [L.month_key()], b, path + "-m")
    assert sorted(map(tuple, L.department_summary(spark, path).collect())) == sorted(map(tuple, marts.i4_department_summary(fact).collect()))
    assert sorted(map(tuple, L.monthly_summary(spark, path + "-m").collect())) == sorted(map(tuple, marts.i3_monthly_summary(fact).collect()))


def test_views_and_table_function(spark):
    fact = load_fact(spark, SF)
    L.register_views(fact)
    want = {r.department: r.efficiency_score for r in marts.i5_department_efficiency(fact).collect()}
    assert [r.efficiency_score for r in spark.sql("SELECT * FROM department_efficiency('2-HIGH')").collect()] == [want["2-HIGH"]]
    assert spark.sql("SELECT * FROM department_efficiency('none')").count() == 0
    assert spark.table("vw_high_risk_admissions").count() == marts.i1_high_risk_admissions(fact).count()
