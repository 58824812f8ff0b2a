"""Nearest neighbours with adaptive scans over rotated dimensions.

Vectors are sorted into lists around centroids. A query looks into its nearest lists. Inside
a list, vectors are rotated at random and read a block of columns at a time: the distance
over the columns seen so far, scaled up, estimates the whole distance, and a candidate that
is beyond the best ones found by more than the estimate's error is given up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import written

NEIGHBOURS = 10
QUERY_EVERY = 100
#: Vectors that centroids and the number of lists to look into are fitted on, by hash of id.
FIT_VECTORS = 20_000
FIT_QUERIES = 200
#: Up to so many lists have centroids of one level. More hang on a tree of two levels, the lower
#: one fitted in tasks, on FIT_ROWS sampled vectors a list.
FLAT_LISTS = 1024
FIT_ROWS = 32
RECALL = 0.98
#: Columns read between two tests, and how many standard errors a candidate is granted.
BLOCK = 16
ERRORS = 2.1
#: Vectors of a list that one task group should hold, and those scanned between two updates.
GROUP_ROWS = 4096
STEP = 256
SALTS = 64
#: Distances held at a time.
CELLS_AT_A_TIME = 1 << 22


@dataclass
class Index:
    """Rotation, centroids (of vectors as they are) and the number of lists to look into. Of a
    tree: ``tops`` are the upper centroids, and ``ends`` where the lists of each end."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    tops: np.ndarray | None = None
    ends: np.ndarray | None = None

    def lists(self, vectors: np.ndarray, start: int, stop: int) -> np.ndarray:
        """The nearest lists of every vector, nearest first, from place ``start`` to ``stop``."""
        found = np.zeros((len(vectors), stop - start), dtype=np.int32)
        step = max(1, CELLS_AT_A_TIME // len(self.centroids))
        for at in range(0, len(vectors), step):
            apart = _apart(vectors[at : at + step], self.centroids)
            found[at : at + step] = np.argsort(apart, axis=1, kind="stable")[:, start:stop]
        return found

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """The list each vector is kept in: the nearest one, in a tree among those of the nearest
        upper centroid."""
        if self.tops is None:
            return self.lists(vectors, 0, 1)[:, 0]
        upper = nearest_rows(vectors, self.tops)
        found = np.zeros(len(vectors), dtype=np.int32)
        for top in np.unique(upper):
            start, stop = (self.ends[top - 1] if top else 0), self.ends[top]
            mine = upper == top
            found[mine] = start + nearest_rows(vectors[mine], self.centroids[start:stop])
        return found


def _apart(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less what is the same for all centres."""
    return (centres**2).sum(axis=1) - 2 * vectors @ centres.T


def nearest_rows(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, CELLS_AT_A_TIME // len(centres))
    found = [_apart(vectors[at : at + step], centres).argmin(axis=1) for at in range(0, len(vectors), step)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has no null or non-finite part, is not zero, and has the most common
    length (of equally common ones the largest)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size(v) == (sizes.n if sizes else 0))


def distinct_vectors(rows: DataFrame, ids_kept: int) -> DataFrame:
    """(h1, h2, embedding, vid, ids): one row per different vector, with its smallest ids (``vid`` is
    the first of them; an id may stand for several vectors).

    A vector's copies are all at one distance, so of equal ones only the smallest ids can be
    among the nearest; an id counts once, however often its row repeats. They are picked without
    the vectors and in two steps, within parts of a hash of the id first, so that a vector with
    very many copies is not sorted in one task. The vectors are combined before they are shuffled.
    """
    key = [F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2")]
    named = rows.select(*key, "vec_id").distinct()
    salted = named.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))

    def smallest(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("vec_id")
        return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= ids_kept).drop("_rn")

    few = smallest(smallest(salted, "h1", "h2", "salt"), "h1", "h2")
    ids = few.groupBy("h1", "h2").agg(F.min("vec_id").alias("vid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = rows.select(*key, "embedding").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    return vectors.join(ids, ["h1", "h2"])


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, which all have one length."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    dice = np.random.default_rng(7)
    centres = rows[dice.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        mine = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, rows)
        sizes = np.bincount(mine, minlength=k)[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def _sampled(vectors: DataFrame, n: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``n`` rows, by hash of the vector."""
    place = F.pmod(F.xxhash64(F.lit(7), "h1"), F.lit(1 << 30)) / float(1 << 30)
    return vectors.filter(place < min(1.0, wanted / max(1, n)))


def _grown(vectors: DataFrame, n: int, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper centroids, centroids of about ``k`` lists, and where the lists of each upper one end.

    The upper level is fitted on ``rows``; below it every branch is fitted in a task, on its
    vectors of a sample of ``FIT_ROWS`` for each list. The driver holds centroids only.
    """
    tops = _kmeans(rows, max(1, round(math.sqrt(k))))
    each = math.ceil(k / len(tops))

    def branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                top = nearest_rows(_rows_of(batch), tops).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(top), batch.column("embedding")], names=["top", "embedding"])

    def centred(group: pd.DataFrame) -> pd.DataFrame:
        mine = _stack(group["embedding"])
        mine = mine[np.lexsort(mine.T)]  # the same for any order of arrival
        centres = _kmeans(mine, min(each, len(mine)))
        return pd.DataFrame({"top": group["top"].iloc[0], "embedding": list(centres)})

    schema = "top int, embedding array<double>"
    sample = _sampled(vectors, n, FIT_ROWS * k).select("embedding").mapInArrow(branched, schema)
    found = sample.groupBy("top").applyInPandas(centred, schema).toPandas()
    found = found.sort_values("top", kind="stable")
    centres = {t: _stack(g["embedding"]) for t, g in found.groupby("top")}
    # A branch that the sample has no vector of has one list, its upper centroid.
    branches = [centres.get(t, tops[t : t + 1]) for t in range(len(tops))]
    return tops, np.concatenate(branches), np.cumsum([len(b) for b in branches])


def fit(vectors: DataFrame, n: int, neighbours: int = NEIGHBOURS) -> Index | None:
    """The index of ``vectors`` (``vid``, ``h1``, ``embedding``, ``n`` rows).

    There are about as many lists as the root of ``n``. The driver holds a sample of about
    ``FIT_VECTORS`` rows, by hash of the vector; beyond ``FLAT_LISTS`` lists a tree of centroids is
    grown in tasks. The number of lists to look into is the smallest that finds ``RECALL`` of the
    true neighbours of ``FIT_QUERIES`` sampled vectors within the sample.
    """
    sample = _sampled(vectors, n, FIT_VECTORS).orderBy("vid", "h1").select("embedding").toPandas()
    if not len(sample):
        return None
    rows = _stack(sample["embedding"])
    k = max(1, round(math.sqrt(n)))
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(rows.shape[1],) * 2))[0]
    if k <= FLAT_LISTS:
        index = Index(rotation, _kmeans(rows, min(k, len(rows))), k)
    else:
        tops, centroids, ends = _grown(vectors, n, k, rows)
        index = Index(rotation, centroids, k, tops, ends)
    k = len(index.centroids)
    asked = rows[:: max(1, len(rows) // FIT_QUERIES)][:FIT_QUERIES]
    near = np.argsort((rows**2).sum(axis=1) - 2 * asked @ rows.T, axis=1)[:, : neighbours + 1]  # with the asked one
    own = index.own(rows)
    place_of = np.argsort(index.lists(asked, 0, k), axis=1)  # rank of every list for every query
    ranks = np.take_along_axis(place_of, own[near], axis=1)
    found = np.array([(ranks < p).mean() for p in range(1, k + 1)])
    index.probes = int(np.argmax(found >= min(RECALL, found[-1]))) + 1
    return index


def scan(index: Index, queries: np.ndarray, rows: np.ndarray, wanted: int) -> list[np.ndarray]:
    """For every query the places of its ``wanted`` nearest rows, as far as the tests let through."""
    dims = rows.shape[1]
    turned_rows, turned_queries = rows @ index.rotation, queries @ index.rotation
    marks = list(range(BLOCK, dims, BLOCK)) + [dims]
    found = []
    for q in turned_queries:
        best_place, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        limit = np.inf
        for start in range(0, len(rows), STEP):
            alive = np.arange(start, min(start + STEP, len(rows)))
            partial, seen = np.zeros(len(alive)), 0
            for mark in marks:
                part = turned_rows[alive, seen:mark] - q[seen:mark]
                partial = partial + np.einsum("ij,ij->i", part, part)
                seen = mark
                if seen < dims and limit < np.inf:
                    # Estimated whole distance against the worst of the best, with its error.
                    keep = partial * (dims / seen) <= limit * (1 + ERRORS / math.sqrt(seen)) ** 2
                    alive, partial = alive[keep], partial[keep]
                    if not len(alive):
                        break
            if len(alive):
                best_place, best = np.append(best_place, alive), np.append(best, partial)
                if len(best) > wanted:
                    # Rounding must not decide between equal distances: near ties all stay.
                    limit = np.partition(best, wanted - 1)[wanted - 1] * (1 + 1e-9) + 1e-12
                    best_place, best = best_place[best <= limit], best[best <= limit]
        found.append(best_place)
    return found


def _scanned(index: Index, candidates: DataFrame, questions: DataFrame, wanted: int) -> DataFrame:
    """(qvid, qh, vid, h1, score): the nearest candidates of every question in the lists it asks.

    ``candidates`` have ``list``, ``vid``, ``h1``, ``embedding``, ``questions`` the same for the lists
    asked; ``vid`` and ``h1`` together name a vector.
    Lists of many candidates, and those asked by many, are cut by hash; every part of the ones
    meets every part of the others in a task group of its own, so both sides of one are bounded.
    """
    # One row per list, as many as the root of the table.
    sizes = written(
        candidates.groupBy("list").agg(F.count("*").alias("n"))
        .join(questions.groupBy("list").agg(F.count("*").alias("m")), "list")
        .select(
            "list", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"),
            F.ceil(F.col("m") / GROUP_ROWS).cast("int").alias("askers"),
        )
    )

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = df.join(sizes, "list").withColumn(f"in_{own}", F.pmod(F.xxhash64("h1"), F.col(own)).cast("int"))
        return rows.withColumn(f"in_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    names = ("list", "in_parts", "in_askers")
    there = dealt(candidates, "parts", "askers").select(*names, "vid", "h1", "embedding")
    asked = dealt(questions, "askers", "parts").select(
        *(F.col(c).alias(f"q_{c}") for c in (*names, "vid", "h1", "embedding"))
    )

    def scanned(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame({c: [] for c in ("qvid", "qh", "vid", "h1", "score")})
        q, x = _stack(asked["q_embedding"]), _stack(there["embedding"])
        ids = there["vid"].to_numpy()
        found = scan(index, q, x, wanted)
        score = [np.sqrt(((x[places] - q[i]) ** 2).sum(axis=1)) for i, places in enumerate(found)]
        # Exact distances decide, and the smaller id where they are equal.
        best = [np.lexsort((ids[p], s))[:wanted] for p, s in zip(found, score)]
        askers = np.repeat(np.arange(len(q)), [len(b) for b in best])
        places = np.concatenate([p[b] for p, b in zip(found, best)])
        return pd.DataFrame(
            {
                "qvid": asked["q_vid"].to_numpy()[askers],
                "qh": asked["q_h1"].to_numpy()[askers],
                "vid": ids[places],
                "h1": there["h1"].to_numpy()[places],
                "score": np.concatenate([s[b] for s, b in zip(score, best)]),
            }
        )

    near = (
        asked.groupBy(*(f"q_{c}" for c in names)).cogroup(there.groupBy(*names))
        .applyInPandas(scanned, "qvid bigint, qh bigint, vid bigint, h1 bigint, score double")
    )
    by_vector = Window.partitionBy("qvid", "qh").orderBy("score", "vid", "h1")
    return near.withColumn("_rn", F.row_number().over(by_vector)).filter(F.col("_rn") <= wanted).drop("_rn")


def search(
    vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the nearest rows of every query row.

    ``vectors`` has ``vec_id`` and ``embedding``. Candidates are all rows but the query's own;
    equal distances go to the smaller ``vec_id``; with fewer candidates all are returned.
    Vectors that are null, zero, have null or non-finite parts, an unusual length or a null id
    take no part. Rows that repeat an id and a vector are one row; under one id and different
    vectors they are candidates each, and a query by that id asks with all of them. ``score`` is
    the Euclidean distance of the vectors as given, in double precision. An empty table gives no
    rows; other columns are not read.

    Every row is indexed. Equal vectors are one candidate with its smallest ids, and one
    query. Queries whose lists held fewer rows than wanted look into further ones, twice as many
    each time, until they have them or have seen all lists.
    """
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession
    rows = written(
        usable(vectors.filter("vec_id is not null")).select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
    )
    wanted = neighbours + 1
    held = written(distinct_vectors(rows, wanted))
    index = fit(held, held.count(), neighbours)
    if index is None:
        return spark.createDataFrame([], schema)

    name = ["vid", "h1"]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = pa.array(index.own(_rows_of(batch)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own, *batch.columns], names=["list", *batch.schema.names])

    candidates = written(
        held.select(*name, "embedding").mapInArrow(kept, "list int, vid bigint, h1 bigint, embedding array<double>")
    )
    key = [F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2")]
    asking = written(
        rows.filter("asks").select(F.col("vec_id").alias("query_id"), *key).distinct()
        .join(held.select("h1", "h2", "vid"), ["h1", "h2"]).select("query_id", *name)
    )

    def answers(who: DataFrame, start: int, stop: int) -> DataFrame:
        """What the lists from place ``start`` to ``stop`` answer."""

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    lists = pa.array(list(index.lists(_rows_of(batch), start, stop)), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([lists, *batch.columns], names=["lists", *batch.schema.names])

        vectors = who.select(*name).distinct().join(held.select(*name, "embedding"), name)
        listed = vectors.mapInArrow(asked, "lists array<int>, vid bigint, h1 bigint, embedding array<double>")
        questions = written(listed.select(F.explode("lists").alias("list"), *name, "embedding"))
        near = _scanned(index, candidates, questions, wanted)
        return (
            near.join(held.select(*name, "ids"), name)
            .join(who.select("query_id", F.col("vid").alias("qvid"), F.col("h1").alias("qh")), ["qvid", "qh"])
            .select("query_id", "score", F.explode("ids").alias("vec_id"))
            .filter("vec_id <> query_id").distinct()
        )

    found, seen = written(answers(asking, 0, index.probes)), index.probes
    while seen < len(index.centroids):
        counts = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
        short = asking.join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < neighbours)
        short = written(short.select("query_id", *name))
        if not short.count():
            break
        upto = min(2 * seen, len(index.centroids))
        found, seen = written(found.unionByName(answers(short, seen, upto))), upto
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= neighbours)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest_report(vectors: DataFrame) -> DataFrame:
    """The neighbours of every row whose id is divisible by ``QUERY_EVERY``."""
    return search(vectors, F.col("vec_id") % QUERY_EVERY == 0)
