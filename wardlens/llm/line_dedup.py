"""Removal of boilerplate lines by their frequency within a site.

For each host the share of its pages that contain a line is the number of
such pages over the number of pages of the host.  Lines above a ratio are
dropped from every page of the host.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.storage import BROADCAST_BYTES, stored

RATIO = 0.05
LEAST_PAGES = 5
#: Copies of a host's list of lines when it goes by a shuffle, so that the pages of one host are dealt to as many tasks.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    """128 bits that stand for a line, without the white space around it."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(7), bare).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, key)`` of every line that is on at least ``least_pages`` pages of a host and on more than ``ratio`` of them.

    Counts are pre-aggregated before the shuffle on (host, line), so neither
    a hot host nor a hot line gathers in one task.
    """
    name = F.col(host).cast("string").alias("host")
    pages = docs.groupBy(name).agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _line_key))
    on = docs.select(name, F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") >= least_pages)
    on, pages = on.alias("l"), pages.alias("p")
    return on.join(pages, F.col("l.host").eqNullSafe(F.col("p.host"))).where(F.col("n") > F.col("pages") * ratio) \
        .select(F.col("l.host").alias("host"), "key")


def without_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with ``text`` less its boilerplate lines, and with ``n_lines`` and ``n_removed``.

    Every row stays, repeated ones too, each as a page.  A null host is a
    host; a null text counts as empty, has one empty line and becomes empty.
    Blank lines are never boilerplate.  Lines are compared without spaces
    around them.  All other columns are returned as they are; columns named
    ``n_lines`` or ``n_removed`` are replaced.  An empty table gives an empty
    result.
    """
    bad = stored(boilerplate(docs, host, ratio, least_pages).groupBy("host").agg(F.collect_list("key").alias("__bad")), "boilerplate")
    bad = bad.withColumnRenamed("host", "__host")
    size = bad.agg(F.sum(F.size("__bad") * 16 + 64)).first()[0] or 0
    name = F.col(host).cast("string")
    rows = docs.drop("n_lines", "n_removed")
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(bad), name.eqNullSafe(F.col("__host")), "left")
    else:
        bad = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")
        rows = rows.join(bad, name.eqNullSafe(F.col("__host")) & (salt == F.col("__salt")), "left").drop("__salt")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("__bad").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__bad"), _line_key(x))))
    rows = rows.withColumns({"n_lines": F.size(lines).cast("long"), "__kept": kept})
    return rows.withColumns({"n_removed": F.col("n_lines") - F.size("__kept"), "text": F.array_join("__kept", "\n")}) \
        .drop("__kept", "__bad", "__host")


def oracle(table: str = "documents", ratio: float = RATIO, least_pages: int = LEAST_PAGES, into: str = "lines_removed") -> str:
    """DuckDB common table expressions ending in ``into(doc_id, n_lines, n_removed, text)`` plus all columns of ``table``."""
    return f"""
    split_{into} as (select *, row_number() over () as rid, string_split(coalesce(text, ''), chr(10)) as ls from {table}),
    pages_{into} as (select source, count(*) as pages from split_{into} group by source),
    on_{into} as (select source, l, count(*) as n from (
        select source, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ')))) as l from split_{into}) where l <> '' group by source, l),
    bad_{into} as (select o.source, list(l) as bad from on_{into} o join pages_{into} p on o.source is not distinct from p.source
        where n >= {least_pages} and n > pages * {ratio} group by o.source),
    {into} as (select s.* exclude (text, rid, ls, n_chars), s.n_chars, cast(len(ls) as bigint) as n_lines,
        cast(len(ls) - len(list_filter(ls, lambda x: bad is null or not list_contains(bad, trim(x, ' ')))) as bigint) as n_removed,
        array_to_string(list_filter(ls, lambda x: bad is null or not list_contains(bad, trim(x, ' '))), chr(10)) as text
        from split_{into} s left join bad_{into} b on s.source is not distinct from b.source)"""
