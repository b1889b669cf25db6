"""Length-of-stay outlier alert (the insert-time check), batch and stream.

Every admission is kept; those with a stay above the threshold also produce
an alert row.  The streaming job reads new admission files with Structured
Streaming and, per micro-batch, appends the admissions to the fact folder
and the alerts to the alerts folder.  Each batch writes into its own
``batch_id=<n>`` sub-folder with overwrite, so a batch replayed after a
failure rewrites the same files instead of duplicating them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOS_ALERT_DAYS = 30


def tag(df: DataFrame, threshold: int = LOS_ALERT_DAYS) -> DataFrame:
    return df.withColumn("los_outlier", F.coalesce(F.col("length_of_stay") > threshold, F.lit(False)))


def alerts(df: DataFrame, threshold: int = LOS_ALERT_DAYS) -> DataFrame:
    # The wording of the message.
    return df.where(F.col("length_of_stay") > threshold).select(
        "admission_id", "mrd_no", "length_of_stay",
        F.concat(F.lit("Outlier Detected: LOS = "), F.col("length_of_stay").cast("string"),
                 F.lit(" for patient "), F.coalesce("mrd_no", F.lit("unknown"))).alias("message"))


def run_stream(spark: SparkSession, source_dir: str, fact_dir: str, alerts_dir: str, checkpoint: str,
               threshold: int = LOS_ALERT_DAYS, schema=None):
    """Process every file present in ``source_dir`` (availableNow trigger)
    and return the finished ``StreamingQuery``."""
    schema = schema or spark.read.parquet(source_dir).schema
    src = spark.readStream.schema(schema).parquet(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{fact_dir}/batch_id={batch_id}")
        alerts(batch, threshold).write.mode("overwrite").parquet(f"{alerts_dir}/batch_id={batch_id}")
        batch.unpersist()

    q = (src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
