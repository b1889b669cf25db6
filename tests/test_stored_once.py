"""Tables stored once: read again, derived anew when the inputs change or the table is gone."""

import shutil

from wardlens.session import stored_once


def test_stored_once(spark, tmp_path):
    source, built = str(tmp_path / "in.parquet"), []

    def table():
        def build():
            built.append(1)
            return spark.read.parquet(source).selectExpr("id * 2 as twice")
        return stored_once(spark, "twice", [source], build)
    spark.range(5).write.parquet(source)
    assert sorted(r.twice for r in table().collect()) == sorted(r.twice for r in table().collect()) == [0, 2, 4, 6, 8] and len(built) == 1
    shutil.rmtree(table().inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert table().count() == 5 and len(built) == 2
    spark.range(7).write.mode("overwrite").parquet(source)
    assert table().count() == 7 and len(built) == 3
