"""One query for each operator, over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import bpe, decontam, html_extract, kneser_ney, line_dedup, lm_score, minhash, packing, pii, spelling, substring, whitening, winnowing
from wardlens.llm.storage import ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.scores(_table(spark, sf_dir, "documents"))
    return found.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap."""
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "place", "span", "n_equal", "item_words")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.perplexities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_boilerplate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


OP10_SQL = f"""with {line_dedup.oracle()}
select doc_id, n_lines, n_removed, sha256(text) as text_sha256 from lines_removed"""

def _words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


OP8_SQL = f"""with recursive w as (select row_number() over () as rid, doc_id, {_words_sql('text')} as ws from documents),
starts as (select rid, unnest(range(1, len(ws) - {substring.LENGTH} + 2)) as i, ws from w where len(ws) >= {substring.LENGTH}),
keyed as (select rid, i, md5(array_to_string(ws[i:i + {substring.LENGTH - 1}], ' ')) as k from starts),
again as (select k from keyed group by k having count(*) > 1),
gone as (select distinct rid, unnest(range(i, i + {substring.LENGTH})) as j from keyed join again using (k)),
per as (select rid, list(j) as js from gone group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(js), 0) as bigint) as n_removed,
  sha256(array_to_string(case when js is null then ws else list_filter(ws, lambda x, p: not list_contains(js, p)) end, ' ')) as kept_sha256
from w left join per using (rid)"""

OP2_SQL = f"""with w as (select row_number() over () as rid, doc_id, {_words_sql('text')} as ws from documents),
p as (select rid, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as x, unnest([null] || ws[:-2]) as before from w where len(ws) > 0),
n as (select count(*) as n from p),
one as (select x, count(*) as c from p group by x),
own_one as (select rid, x, count(*) as c from p group by rid, x),
two as (select before, x, count(*) as c from p where i > 1 group by before, x),
own_two as (select rid, before, x, count(*) as c from p where i > 1 group by rid, before, x),
scored as (select p.rid, p.i, case when t.c - ot.c > 0 then (t.c - ot.c) / (b.c - ob.c)
    else case when p.i > 1 then {lm_score.BACKOFF} else 1 end * greatest(o.c - oo.c, 0.5) / greatest(n.n - len(w.ws), 1) end as s,
    p.i > 1 and t.c - ot.c = 0 as backed_off
  from p join w using (rid) cross join n join one o on o.x = p.x join own_one oo on oo.rid = p.rid and oo.x = p.x
  left join two t on t.before = p.before and t.x = p.x left join own_two ot on ot.rid = p.rid and ot.before = p.before and ot.x = p.x
  left join one b on b.x = p.before left join own_one ob on ob.rid = p.rid and ob.x = p.before),
sums as (select rid, sum(ln(s)) as log_score, count(*) filter (backed_off) as n_backed_off from scored group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_backed_off, 0) as bigint) as n_backed_off,
  round(coalesce(log_score, 0), 4) as log_score, round(log_score / len(ws), 6) as mean_log_score
from w left join sums using (rid)"""

QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_lm_scoring, op3_minhash_near_dedup, op4_packing, op5_pii, op6_document_fingerprints,
    op7_benchmark_decontamination, op8_substring_dedup, op9_quality_classifier, op10_line_dedup, op11_embedding_whitening,
    op12_spelling_variants, op13_bpe_encoding)}

SQL = {"op2_lm_scoring": OP2_SQL, "op8_substring_dedup": OP8_SQL, "op10_line_dedup": OP10_SQL}
