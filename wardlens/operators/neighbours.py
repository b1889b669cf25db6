"""Neighbour lists of many rows by an inverted file of cells.

Rows are unit vectors.  Centroids are fitted by k-means on a bounded sample and
every vector is filed in the cell of its nearest centroid.  A query looks into
the few cells whose centroids are nearest to it, and the best of each cell are
merged.  That is the approximate answer.  Its last neighbour then bounds the
distance of any better one, and a cell none of whose members can be that near
(by the triangle inequality, from the distance to its centroid and the cell's
radius, or by the plane between its centroid and the query's) is out; the cells that remain are looked into as well, which makes the
answer exact.

Equal vectors are filed once with their smallest ids, so a third of all rows
being copies costs one entry.  Cells are cut into chunks of rows and of
queries, so no task holds a whole cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.session import cut_lineage

#: Vectors of the sample that the centroids are fitted on, the first by hash, for each cell, and the most cells; twice the root of the vectors
#: is enough of them.
PER_CELL, MOST_CELLS = 64, 2048
#: Cells that a query looks into at first.
PROBES = 6
#: Vectors of a cell, and queries to it, that one task holds.
CHUNK = 4096
#: Similarities are compared after rounding, so that ties are ties on any machine.
DIGITS = 9


@dataclass
class Index:
    """Filed vectors: ``entries(v, ids, cell)``, the centroids as rows of a matrix, and each cell's radius and size."""

    entries: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    keep: int


def unit_vector(columns: list[str]) -> Column:
    """The columns as an array of length 1; null where all are zero or one is null."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
    return F.when(norm > 0, F.array(*[F.col(c) / norm for c in columns]))


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The distances of vectors (rows) to centroids (columns)."""
    square = (vectors ** 2).sum(1)[:, None] + (centroids ** 2).sum(1)[None] - 2 * vectors @ centroids.T
    return np.sqrt(np.maximum(square, 0.0))


def build(rows: DataFrame, k: int, seed: int = 42) -> Index | None:
    """File ``rows(id, v)``, v a unit vector or null; a null vector has no place.  ``k``: the longest list that will be asked for."""
    smallest = F.slice(F.array_sort(F.collect_list("id")), 1, k + 1)
    # A vector's smallest ids, within shards first: a list never grows with the copies of a vector.
    ranked = rows.where("v is not null").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(64)))
    own = Window.partitionBy("v", "shard").orderBy("id")
    firsts = ranked.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1)
    distinct = cut_lineage(firsts.groupBy("v").agg(smallest.alias("ids")))
    n = distinct.count()
    if not n:
        return None
    cells = int(max(1, min(MOST_CELLS, n // PER_CELL, 2 * n ** 0.5)))
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(cells * PER_CELL).select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(cut_lineage(sample)) if cells > 1 else None
    first = distinct.select("v").first()["v"]
    centroids = np.array([c for c in model.clusterCenters()] if model else [first])

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            away = _nearest(np.stack(part["v"].to_numpy()), centroids)
            cell = away.argmin(1)
            yield part.assign(cell=cell.astype("int32"), away=away[np.arange(len(part)), cell])
    entries = cut_lineage(distinct.mapInPandas(file, "v array<double>, ids array<bigint>, cell int, away double"))
    radius, size = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in entries.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("size")).collect():  # a row for each centroid at most
        radius[r["cell"]], size[r["cell"]] = r["radius"], r["size"]
    return Index(entries.drop("away"), centroids, radius, size, k + 1)


def _asked(queries: DataFrame, index: Index, chosen) -> DataFrame:
    """``(q, cell, row_chunk)``: one row for each cell that ``chosen(distances, worst)`` picks and each chunk of it."""
    centroids, filled, chunks = index.centroids, index.size > 0, np.maximum(1, -(-index.size // CHUNK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), 256):
                own = part.iloc[i:i + 256]
                away = _nearest(np.stack(own["q"].to_numpy()), centroids)
                at, cell = np.nonzero(chosen(away, own["worst"].to_numpy(dtype=float)) & filled)
                of, chunk = np.repeat(np.arange(len(at)), chunks[cell]), np.concatenate([np.arange(chunks[c]) for c in cell]) if len(cell) else np.zeros(0)
                yield pd.DataFrame({"q": own["q"].to_numpy()[at[of]], "cell": cell[of].astype("int32"), "row_chunk": chunk.astype("int32")})
    return cut_lineage(queries.select("q", "worst").mapInPandas(run, "q array<double>, cell int, row_chunk int"))


def _looked_up(asked: DataFrame, index: Index) -> DataFrame:
    """``(q, v, ids, score)``: of each chunk the best entries for each query that asks it, as many as its list could need."""
    keep = index.keep
    asks = np.zeros(len(index.size), np.int64)
    for r in asked.where("row_chunk = 0").groupBy("cell").count().collect():  # a row for each centroid at most
        asks[r["cell"]] = r["count"]

    def chunks(sizes: np.ndarray, values: str) -> Column:
        of = F.array(*[F.lit(int(max(1, -(-n // CHUNK)))) for n in sizes])[F.col("cell")]
        return F.pmod(F.xxhash64(values), of).cast("int") if values else F.explode(F.sequence(F.lit(0), of - 1))
    keys = ["cell", "row_chunk", "query_chunk"]
    asked = asked.withColumn("query_chunk", chunks(asks, "q"))
    asked_cells = F.array(*[F.lit(bool(n)) for n in asks])[F.col("cell")]
    rows = index.entries.where(asked_cells).withColumn("row_chunk", chunks(index.size, "v")).withColumn("query_chunk", chunks(asks, ""))

    def best(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(entries):
            q, v = np.stack(queries["q"].to_numpy()), np.stack(entries["v"].to_numpy())
            low = np.array([x[0] for x in entries["ids"]])
            for i in range(0, len(q), 512):
                scores = q[i:i + 512] @ v.T
                # All that may tie with the last place of a list after rounding; a whole order of the cell is not needed.
                last = np.partition(scores, -keep, axis=1)[:, -keep] if len(v) > keep else np.full(len(scores), -np.inf)
                at, entry = np.nonzero(scores >= last[:, None] - 10.0 ** -(DIGITS - 1))
                score = np.round(scores[at, entry], DIGITS)
                # By score, then by the smallest id: more than ``keep`` distinct vectors ahead leave no place in a list.
                order = np.lexsort((low[entry], -score, at))
                at, entry, score = at[order], entry[order], score[order]
                own = np.arange(len(at)) - np.searchsorted(at, at) < keep
                at, entry, score = at[own], entry[own], score[own]
                out.append(pd.DataFrame({"q": queries["q"].to_numpy()[i + at], "ids": entries["ids"].to_numpy()[entry], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "ids": [], "score": []})
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(best, "q array<double>, ids array<bigint>, score double")


def _top(found: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` entries of each query vector."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r")


def neighbours(index: Index | None, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """``(id, rank, neighbour, score)`` of each row of ``queries(id, v)``: the ``k`` rows of the index nearest by cosine, the row's own id left out.

    Ties of the rounded similarity go to the smaller id.  A query without a
    vector, and any query of an empty index, has no neighbours.  With
    ``exact`` false only the nearest ``probes`` cells are looked into.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "id bigint, rank int, neighbour bigint, score double")
    if k + 1 > index.keep:
        raise ValueError(f"the index keeps lists of {index.keep - 1}")
    wanted = cut_lineage(queries.where("v is not null").select("v").distinct().select(F.col("v").alias("q"), F.lit(None).cast("double").alias("worst")))

    radius, filled, between = index.radius[None], index.size > 0, _nearest(index.centroids, index.centroids)

    def nearest(away: np.ndarray, _: np.ndarray) -> np.ndarray:
        rank = np.where(filled, away, np.inf).argsort(1, kind="stable").argsort(1, kind="stable")
        return rank < probes

    def in_reach(away: np.ndarray, worst: np.ndarray) -> np.ndarray:
        # What a rounded similarity may hide, and rounding of the distances, are allowed for.
        far = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(0.0, 2 - 2 * worst + 1e-8)) + 1e-7)
        # A member is nearer to its own centroid than to the query's, so it lies beyond the plane half-way between the two.
        own = away.argmin(1)
        beyond = (away ** 2 - away[np.arange(len(away)), own][:, None] ** 2) / np.maximum(2 * between[own], 1e-3)
        return (away - radius <= far[:, None]) & (beyond <= far[:, None] + 1e-6) & ~nearest(away, worst)
    top = cut_lineage(_top(_looked_up(_asked(wanted, index, nearest), index), index.keep))
    if exact:
        # The list ends at the keep-th id at the latest; a query with fewer ids looks everywhere.
        at_least = F.sum(F.size("ids")).over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))
        worst = top.withColumn("n", at_least).where(F.col("n") >= index.keep).groupBy("q").agg(F.max("score").alias("worst"))
        again = wanted.select("q").join(worst, "q", "left")
        top = cut_lineage(_top(top.unionByName(_looked_up(_asked(again, index, in_reach), index)), index.keep))
    each = queries.where("v is not null").select("id", F.col("v").alias("q")).join(top, "q") \
        .select("id", "score", F.explode("ids").alias("neighbour")).where("neighbour <> id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbour", "score")


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(found, wanted, recall)``: the share of the exact neighbours that the approximate lists hold."""
    hit = approximate.select("id", "neighbour", F.lit(1).alias("hit"))
    return exact.join(hit, ["id", "neighbour"], "left").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted")) \
        .withColumn("recall", F.col("found") / F.nullif(F.col("wanted"), F.lit(0)))
