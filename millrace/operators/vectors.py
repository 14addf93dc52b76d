"""Vector search by an inverted file: vectors lie in lists by their nearest centroid, a query looks at the lists near to it.

The centroids come from k-means over a bounded sample; every row is in the index. A query's lists and an item's list are
joined by equality, so there is no product of queries and corpus, and scores in the lists are exact. Either the number of
lists is fixed (approximate, with the recall that tuned() measured for it), or bounds of the lists say which ones can still
hold one of the best (exact).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.nearest import best
from millrace.operators.search import dot, top
from millrace.sources.scratch import stored

#: Most lists, sample rows for each, rounds of k-means; queries and neighbours on which the number of probes is tuned.
LISTS, PER_LIST, ITERATIONS, TRIALS, NEIGHBOURS, RECALL = 1024, 50, 8, 200, 10, 0.97
#: Most pairs of a query and a list that are broadcast.
FEW = 20_000_000
SLACK = 2e-6  # scores are ranked by six digits


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; null vectors and null numbers are zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(np.asarray(column.offsets)) * np.asarray(column.is_valid())
    if (size[size > 0] != width).any():
        raise ValueError(f"vectors must have {width} numbers")
    out[size > 0] = np.nan_to_num(flat).reshape(-1, width)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _angles(m: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(m) @ centers.T, -1, 1))


def centroids(corpus: DataFrame, lists: int | None = None, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, sample) of corpus (item, vec): about the root of the number of rows, at most LISTS, by k-means over a
    sample of about PER_LIST rows for each, picked by a hash of the item."""
    n = corpus.count()
    lists = lists or max(1, min(LISTS, math.isqrt(n)))
    some = corpus.where(F.col("vec").isNotNull() & (F.pmod(F.xxhash64("item"), F.lit(max(n, 1))) < lists * PER_LIST)).select("vec")
    sample = some.toArrow()["vec"]
    if not len(sample):
        return np.ones((1, 1)), np.ones((0, 1))
    rows = _matrix(sample, len(sample[0]))
    train = corpus.sparkSession.createDataFrame([(r.tolist(),) for r in rows], "vec array<double>").select(array_to_vector("vec").alias("features"))
    model = KMeans(k=min(lists, len(rows)), seed=seed, maxIter=ITERATIONS).fit(train)
    return _unit(np.array(model.clusterCenters())), rows


def tuned(centers: np.ndarray, sample: np.ndarray, recall: float = RECALL) -> int:
    """The least number of probes with which TRIALS rows of the sample find recall of their nearest rows of the sample."""
    if len(sample) <= NEIGHBOURS:
        return len(centers)
    asked = sample[:: max(1, len(sample) // TRIALS)]
    best = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    order = np.argsort(np.argsort(_angles(asked, centers), axis=1, kind="stable"), axis=1)  # place of each list
    of = _angles(sample, centers).argmin(axis=1)
    places = np.sort(np.take_along_axis(order, of[best], axis=1).ravel())
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1


def indexed(corpus: DataFrame, centers: np.ndarray) -> DataFrame:
    """corpus with list, angle (to the list's centroid) and norm. A null vector counts as zeros: list 0, all scores 0."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in corpus.schema)}, list int, angle double, norm double"
    at = corpus.columns.index("vec")
    sent = corpus.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(at), sent.value.shape[1])
            angle = _angles(m, sent.value)
            own = angle.argmin(axis=1)
            columns = [*b.columns, pa.array(own.astype(np.int32)), pa.array(angle[np.arange(len(own)), own]), pa.array(np.linalg.norm(m, axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "list", "angle", "norm"])

    return corpus.mapInArrow(assign, schema)


def _probed(queries: DataFrame, centers: np.ndarray, pick) -> DataFrame:
    """q, q_vec, list: the lists that pick (angles to the centroids, norms, floors) has, as a matrix of booleans. queries: q,
    q_vec, floor."""
    kind = queries.schema["q"].dataType.simpleString()
    sent = queries.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), sent.value.shape[1])
            row, found = np.nonzero(pick(_angles(m, sent.value), np.linalg.norm(m, axis=1), b.column(2).to_numpy(zero_copy_only=False).astype(float)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(found.astype(np.int32))], names=["q", "q_vec", "list"])

    return queries.select("q", "q_vec", "floor").mapInArrow(run, f"q {kind}, q_vec {queries.schema['q_vec'].dataType.simpleString()}, list int")


def _nearest(angles: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1) < probes


def _scored(queries: DataFrame, asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """q, item, score, rank of the k best in the lists asked for (q, q_vec, list). Up to FEW pairs of query and list are sent
    with the queries, as numbers, and a task multiplies its batches with the vectors of their lists' queries."""
    pairs = stored(asked.select("q", "list"))
    if pairs.count() > FEW:
        found = index.join(asked.hint("merge"), "list").select("q", "item", F.coalesce(dot("q_vec", "vec"), F.lit(0.0)).alias("score"))
        return top(found, "q", "score", "item", k)
    table = queries.select("q", "q_vec").toArrow()
    numbers = table.select(["q"]).to_pandas().reset_index(names="at").merge(pairs.toArrow().to_pandas(), on="q")[["at", "list"]].drop_duplicates()
    groups = {v: some.to_numpy() for v, some in numbers.groupby("list")["at"]}
    return top(best(table, index.select("item", "vec", "list"), k, groups, "list", 0.0), "q", "score", "item", k)


def near_search(queries: DataFrame, index: DataFrame, centers: np.ndarray, k: int, probes: int) -> DataFrame:
    """q, item, score, rank: the k best items in the probes nearest lists of each query (q, q_vec). index: what indexed
    gives, with any filter on its other columns. Approximate: an item in another list isn't found."""
    asked = _probed(queries.select("q", "q_vec", F.lit(0.0).alias("floor")), centers, lambda angles, norms, floors: _nearest(angles, probes))
    return _scored(queries, asked, index, k)


def exact_search(queries: DataFrame, index: DataFrame, centers: np.ndarray, k: int, probes: int) -> DataFrame:
    """The same over all lists. After the nearest ones, a list is looked at only where it can hold one of the k best: a score
    is at most norm of the query * largest norm in the list * cos(angle to the centroid - largest angle in the list)."""
    edges = index.groupBy("list").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm")).toArrow()  # a row a list
    reach, norm = np.full(len(centers), -np.inf), np.full(len(centers), -np.inf)
    reach[edges["list"].to_numpy()], norm[edges["list"].to_numpy()] = edges["angle"].to_numpy(), edges["norm"].to_numpy()
    first = stored(near_search(queries, index, centers, k, probes))
    floor = first.where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    left = queries.join(floor, "q", "left").select("q", "q_vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def open_(angles: np.ndarray, norms: np.ndarray, floors: np.ndarray) -> np.ndarray:
        cos = np.cos(np.minimum(np.maximum(angles - reach - 1e-7, 0), np.pi))
        most = norms[:, None] * np.where(cos > 0, norm, 0) * cos  # below a right angle a small norm is the best
        return (most >= floors[:, None] - SLACK) & (norm >= 0) & ~_nearest(angles, probes)

    more = _scored(left, _probed(left, centers, open_), index, k)
    return top(first.unionByName(more).select("q", "item", "score"), "q", "score", "item", k)
