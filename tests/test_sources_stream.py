import datetime as dt
import os
import tempfile

from conftest import SF_SMALL
from wardlens.sources.files import read_brought_dead
from wardlens.sources.tables import load_fact
from wardlens.streaming import los_alert


def test_brought_dead_register_dirt(spark):
    d = tempfile.mkdtemp(prefix="wardlens-csv-")
    path = os.path.join(d, "dead.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("S.NO,MRD,AGE,GENDER ,RURAL/URBAN,DATE OF BROUGHT DEAD\n")
        f.write("1,234735,81,M,R,4/2/2017\n2,***,60,F,U ,12/31/2018\n3,234736,55,M,0,bad\n")
    rows = read_brought_dead(spark, path).orderBy("sno").collect()
    assert [r.sno for r in rows] == [1, 2, 3]
    assert rows[0].date_of_brought_dead == dt.date(2017, 4, 2)
    assert rows[1].mrd == "***" and rows[1].ruralurban == "U"
    assert rows[2].date_of_brought_dead is None


def test_stream_equals_batch(spark):
    from wardlens.session import ensure_checkpoint_dir
    root = tempfile.mkdtemp(prefix="wardlens-stream-", dir=ensure_checkpoint_dir(spark))
    fact = load_fact(spark, SF_SMALL)
    fact.repartition(3).write.parquet(f"{root}/in")
    los_alert.run_stream(spark, f"{root}/in", f"{root}/fact", f"{root}/alerts", f"{root}/ck")
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{root}/alerts").drop("batch_id").collect())
    batch = sorted(tuple(r) for r in los_alert.alerts(fact).collect())
    assert streamed == batch and len(batch) > 0
    assert spark.read.parquet(f"{root}/fact").count() == fact.count()
