"""A corpus pipeline: five filtering and packing stages over ``documents``, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
reads again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import decontam, kneser_ney, line_dedup, minhash, packing
from wardlens.llm.storage import discard, ready, small_enough, stored


#: Similarity, in percent, from which texts are near-duplicates.
PERCENT = 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """``docs`` with a column that names each row, the column's name, and whether it is ``doc_id`` itself.

    Where a doc_id is missing or repeated, rows get numbers of their own,
    written before use, so that a task that is run again finds the same ones.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count()
    if ids.where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, True
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name, False


def _without(docs: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose number is in the one column of ``gone``; the column of numbers goes too."""
    gone = stored(gone.toDF("gone"), "gone")
    right = F.broadcast(gone) if small_enough(gone, 8) else gone
    return docs.join(right, docs[name] == gone["gone"], "left_anti").drop(name)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's threshold go.

    Each row is judged by its own text, rows of a repeated or null doc_id too;
    rows without words or of a language without trusted documents stay.
    """
    ready(spark)
    rows, name, _ = _numbered(docs)
    scored = kneser_ney.perplexities(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=[name])
    return _without(rows, name, scored.where("not kept").select(name))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; every row stays, with ``n_chars`` counted anew; a null text becomes an empty one."""
    ready(spark)
    cut = line_dedup.without_boilerplate(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id.

    Links are word shingles of five and a similarity of 0.8.  Rows are told
    apart by themselves, not by doc_id: of repeated rows one stays, unlike
    texts of one doc_id both stay.  A null doc_id stays only if its group has
    no other; rows without words are alike to nothing and all stay.
    """
    ready(spark)
    rows, name, by_id = _numbered(docs)
    found = minhash.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"), PERCENT)
    if by_id:
        return _without(rows, name, found.where("not kept").select("doc_id"))
    member = stored(found.select(F.col("doc_id").alias("n"), "component_id"), "members").join(
        rows.select(F.col(name).alias("n"), F.col("doc_id").cast("long").alias("id")), "n")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "n")
    first = member.groupBy("component_id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    gone = member.join(first.select("component_id", F.col("first.n").alias("stays")), "component_id").where("n <> stays")
    return _without(rows, name, gone.select("n"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps a benchmark item go; null and empty texts overlap nothing and stay."""
    ready(spark)
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every remaining row with its place in a sequence; a null or empty text is its end id alone."""
    ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The model of the first stage and the tokens of the last are beyond SQL; tests hold the near-duplicates and the tokens against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # nothing reads it any more; the input itself is not ours and stays
    return docs
