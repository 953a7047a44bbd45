"""Approximate nearest neighbours by inner product: an inverted multi-index.

Entries. Every usable row is a candidate. Equal vectors have equal scores, so of the rows of one
vector only the ``k + 1`` with the smallest ids can ever be among a query's ``k`` nearest (one more, as
the query itself may be one of them); the others are left out before the search, which changes no
result and leaves no vector hot.

Fit. The two halves of the vectors are quantised by separate k-means codebooks, fitted to a sample
of about ``sample_rows`` entries. Their sizes grow with the fourth root of the number of entries, so
the entries of a cell, a pair of centroids, grow with its square root alone. How many entries a
query has to see for the wanted recall is measured on the whole index: for ``tune_queries`` of the
sample the true neighbours among all entries are found by one scan.

Search. For a query, centroids of each half are sorted by their inner product with that half of
the query, and a heap walks the pairs from the largest sum downwards until the cells seen hold
the wanted share, and more than ``k`` entries. (The sum of two inner products orders pairs here as
summed distances do for the Euclidean measure.) Neighbouring cells make blocks of about
``block_rows`` entries, and a cell with more than that is dealt to several. A query goes to the blocks
of its cells with the list of its cells there; a block that more than ``block_queries`` ask is dealt
again, its entries copied for each part. In a block the entries of a cell meet its queries as
matrices; what can be among the best is scored again exactly, in double precision on the original
vectors. Each visit returns its best, and those are merged.

Recall on the queries of a result is measured by ``recall``; the tests hold it to 0.9.

Edge cases: null or zero vectors, and such with null or non-finite components or another number
of components than most, take no part, nor do rows without ``vec_id``. Rows that repeat a ``vec_id``
are candidates and queries each, apart from their own row. Ties go to the smaller ``vec_id``. A query
gets ``k`` rows, or all candidates if there are fewer. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import again, columns, discard, flat_list, hash_sample, materialize, mix

_FOUND = "query long, query_id long, row long, vec_id long, score double"
_OUT = "query_id long, rank int, vec_id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of ``x``, from rows spread over the sample."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(0).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(axis=1)[None] - 2 * (x @ centres.T)).argmin(axis=1)


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, want: float) -> list[int]:
    """Cells ``i * len(right) + j`` by falling ``left[i] + right[j]`` until they hold ``want`` entries."""
    rows, cols = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap = [(-(left[rows[0]] + right[cols[0]]), 0, 0)]
    cells, held = [], 0
    while heap and held < want:
        _, a, b = heapq.heappop(heap)
        cell = int(rows[a]) * len(cols) + int(cols[b])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        if b + 1 < len(cols):
            heapq.heappush(heap, (-(left[rows[a]] + right[cols[b + 1]]), a, b + 1))
        if b == 0 and a + 1 < len(rows):
            heapq.heappush(heap, (-(left[rows[a + 1]] + right[cols[0]]), a + 1, 0))
    return cells


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _scores(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in one order whatever their number."""
    return (entries * queries).sum(axis=1)


def _first_of_each(group: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among the first ``most`` of their group; rows of a group follow each other."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    at = np.arange(len(group))
    return at - np.maximum.accumulate(np.where(new, at, 0)) < most


@dataclass
class MultiIndex:
    """Two codebooks and the share of all entries that a query looks at."""

    first: np.ndarray
    second: np.ndarray
    share: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, centroids: int) -> MultiIndex:
        half = cls.half(x.shape[1])
        return cls(_kmeans(x[:, :half], centroids), _kmeans(x[:, half:], centroids))

    @staticmethod
    def half(width: int) -> int:
        return max(1, width // 2)

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.half(x.shape[1])
        return _nearest(x[:, :half], self.first) * len(self.second) + _nearest(x[:, half:], self.second)

    def visits(self, query: np.ndarray, sizes: np.ndarray, want: float) -> list[int]:
        half = self.half(len(query))
        return walk(self.first @ query[:half], self.second @ query[half:], sizes, want)

    @property
    def n_cells(self) -> int:
        return len(self.first) * len(self.second)

    def tune(self, queries: np.ndarray, true_cells: list[np.ndarray], sizes: np.ndarray, recall: float) -> None:
        """Set the share so that ``recall`` of the true neighbours' cells are walked to."""
        seen_at = []
        for query, cells in zip(queries, true_cells, strict=True):
            before, held = np.zeros(self.n_cells), 0
            for cell in self.visits(query, sizes, np.inf):
                before[cell] = held
                held += int(sizes[cell])
            seen_at.append(before[cells] / max(1, held))
        if seen_at and sum(map(len, seen_at)):
            self.share = min(1.0, float(np.quantile(np.concatenate(seen_at), recall)) + 1 / max(1, int(sizes.sum())))


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v``: the rows that can take part."""
    v = F.col("v")
    good = F.size(v) > 0
    for bad in (F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), ~F.exists(v, lambda x: x != 0)):
        good = good & ~F.coalesce(bad, F.lit(True))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(good)


@dataclass
class Blocks:
    """Which blocks the entries of a cell are in: ``count`` from ``first`` on."""

    first: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, block_rows: int) -> Blocks:
        first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        block, held = 0, 0
        for cell, n in enumerate(sizes.tolist()):
            if held and held + n > block_rows:
                block, held = block + 1, 0
            first[cell] = block
            held += n
            if n > block_rows:
                count[cell] = -(-n // block_rows)
                block, held = block + int(count[cell]), 0
        return cls(first, count)


def _indexed(index: MultiIndex):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, v = columns(batch, "row", "vec_id", "v")
            cells = index.cells(_matrix(v)) if len(ids) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([rows, ids, pa.array(cells.astype(np.int32)), v], ["row", "vec_id", "cell", "v"])

    return assign


def _dealt(blocks: Blocks):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = columns(batch, "row", "cell")
            cell = cells.to_numpy()
            block = blocks.first[cell] + (mix(rows.to_numpy().view(np.uint64)) % blocks.count[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block.astype(np.int32))], [*batch.schema.names, "block"])

    return deal


def _visited(shared, k: int):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and block that holds cells of it, with those cells."""
        index, sizes, blocks = shared.value
        want = max(index.share * sizes.sum(), k + 1)
        for batch in batches:
            rows, ids, v = columns(batch, "row", "vec_id", "v")
            whose, where, lengths, flat = [], [], [], []
            for n, query in enumerate(_matrix(v)):
                cells = np.array(index.visits(query, sizes, want), np.int64)
                count = blocks.count[cells]
                block = np.repeat(blocks.first[cells], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                cells = np.repeat(cells, count)
                order = np.argsort(block, kind="stable")
                names, size = np.unique(block, return_counts=True)
                whose.append(np.full(len(names), n))
                where.append(names)
                lengths.append(size)
                flat.append(cells[order])
            if not whose:
                continue
            at = pa.array(np.concatenate(whose))
            lists = flat_list(np.concatenate(flat).astype(np.int32), np.concatenate(lengths), pa.int32())
            out = pa.RecordBatch.from_arrays([rows.take(at), ids.take(at), v.take(at), lists, pa.array(np.concatenate(where).astype(np.int32))], ["query", "query_id", "q", "cells", "block"])
            for first in range(0, out.num_rows, 4096):
                yield out.slice(first, 4096)

    return visit


def _search(k: int):
    def chosen(x: np.ndarray, rows: np.ndarray, ids: np.ndarray, bounds: dict[int, tuple[int, int]], qs: np.ndarray, own: np.ndarray, wanted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, score) of the best entries of the queries' cells."""
        by_cell = np.repeat(np.arange(len(qs)), [len(w) for w in wanted])
        cells = np.concatenate(wanted)
        order = np.argsort(cells, kind="stable")
        names, first = np.unique(cells[order], return_index=True)
        # Rounding of a matrix product depends on its shape; what is nearly the best stays until it is scored exactly.
        slack = 1e-9 * np.sqrt(np.square(qs).sum(axis=1)) * np.sqrt(np.square(x).sum(axis=1).max())
        near = np.full((len(qs), len(x)), -np.inf)
        for cell, some in zip(names.tolist(), np.split(by_cell[order], first[1:]), strict=True):
            if cell in bounds:
                a, b = bounds[cell]
                near[some, a:b] = np.maximum(qs[some] @ x[a:b].T, -np.finfo(np.float64).max)
        near[own[:, None] == rows[None, :]] = -np.inf
        least = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(qs), -np.inf)
        q, e = np.nonzero((near >= (least - slack)[:, None]) & (near > -np.inf))
        score = _scores(qs[q], x[e])
        order = np.lexsort((rows[e], ids[e], -score, q))
        order = order[_first_of_each(q[order], k)]
        return q[order], e[order], score[order]

    def search(key: tuple, entries: pa.Table, queries: pa.Table) -> pa.Table:
        """The best of a block for each query that visits one of its cells."""
        parts = []
        if entries.num_rows and queries.num_rows:
            order = np.argsort(entries.column("cell").to_numpy(), kind="stable")
            entries = entries.take(pa.array(order))
            x = _matrix(entries.column("v").combine_chunks())
            rows, ids, cells = (entries.column(c).to_numpy() for c in ("row", "vec_id", "cell"))
            names, first = np.unique(cells, return_index=True)
            bounds = {c: (a, b) for c, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(cells)], strict=True)}
            for part in queries.combine_chunks().to_batches(max_chunksize=256):
                query, query_id, q, wanted = columns(part, "query", "query_id", "q", "cells")
                at, e, score = chosen(x, rows, ids, bounds, _matrix(q), query.to_numpy(), [w.values.to_numpy() for w in wanted])
                at = pa.array(at)
                parts.append(pa.RecordBatch.from_arrays([query.take(at), query_id.take(at), pa.array(rows[e]), pa.array(ids[e]), pa.array(score)], [f.split()[0] for f in _FOUND.split(", ")]))
        return pa.Table.from_batches(parts, pa.schema([(f.split()[0], pa.float64() if f.endswith("double") else pa.int64()) for f in _FOUND.split(", ")]))

    return search


def _scan(queries: list[tuple[int, np.ndarray]], k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The true ``k`` nearest in this task of a few queries, with their cells."""
        best: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            rows, ids, cells, v = columns(batch, "row", "vec_id", "cell", "v")
            x, row = _matrix(v), rows.to_numpy()
            for n, (own, query) in enumerate(queries):
                others = np.flatnonzero(row != own)
                score = _scores(query, x[others])
                at = _best(score, ids.to_numpy()[others], k)
                merged = [np.concatenate(z) for z in zip(best[n], (score[at], ids.to_numpy()[others][at], cells.to_numpy()[others][at]), strict=True)]
                at = _best(merged[0], merged[1], k)
                best[n] = tuple(z[at] for z in merged)
        for n, (score, ids, cells) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), n, np.int32)), pa.array(ids.astype(np.int64)), pa.array(cells.astype(np.int32)), pa.array(score)], ["n", "vec_id", "cell", "score"])

    return scan


def nearest_neighbours(vectors: DataFrame, *, k: int = 20, every: int = 20, sample_rows: int = 20_000, tune_queries: int = 64, target: float = 0.94, block_rows: int = 4096, block_queries: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id ``every`` divides.

    ``target`` is the recall that the share of entries to look at is tuned to.
    """
    spark = vectors.sparkSession
    rows = materialize(_usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if width is None:
        return spark.createDataFrame([], _OUT)
    own = rows.filter(F.size("v") == width[0])
    same = Window.partitionBy("v").orderBy("vec_id", "row")
    entries = materialize(own.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1).drop("place"), "distinct-vectors")
    n = entries.count()
    sample = hash_sample(entries, F.xxhash64("v", "vec_id"), sample_rows).orderBy("__key", "vec_id").toArrow().combine_chunks()
    x = _matrix(sample["v"].combine_chunks())
    index = MultiIndex.fit(x, max(2, round(2.5 * n**0.25)))

    placed = materialize(entries.select("row", "vec_id", "v").mapInArrow(_indexed(index), "row long, vec_id long, cell int, v array<double>"), "entries")
    discard(entries)
    sizes = np.zeros(index.n_cells, np.int64)
    for cell, count in placed.groupBy("cell").count().collect():  # a row for each pair of centroids at most
        sizes[cell] = count
    tuning = [(int(r), q) for r, q in zip(sample["row"].to_pylist()[:tune_queries], x, strict=False)]
    nearest = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    true = placed.mapInArrow(_scan(tuning, k), "n int, vec_id long, cell int, score double").withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("n", "cell").toArrow()
    which, cells = true["n"].to_numpy(), true["cell"].to_numpy()
    index.tune(np.array([q for _, q in tuning]), [cells[which == m] for m in range(len(tuning))], sizes, target)
    blocks = Blocks.of(sizes, block_rows)

    shared = spark.sparkContext.broadcast((index, sizes, blocks))
    asked = own.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    queries = materialize(asked.mapInArrow(_visited(shared, k), "query long, query_id long, q array<double>, cells array<int>, block int"), "queries")
    discard(rows)
    parts = materialize(queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("parts")), "visits")
    dealt = placed.mapInArrow(_dealt(blocks), "row long, vec_id long, cell int, v array<double>, block int").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    calls = queries.join(again(parts), "block").withColumn("part", F.pmod(F.xxhash64("query"), "parts").cast("int"))
    found = dealt.groupBy("block", "part").cogroup(calls.groupBy("block", "part")).applyInArrow(_search(k), _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, *, k: int = 20, every: int = 20) -> float:
    """The share of the true nearest neighbours that ``found`` has, against all rows, where ids are unique."""
    rows = _usable(vectors)
    queries = [(r[0], np.array(r[1])) for r in rows.filter(F.col("vec_id") % every == 0).collect()]
    order = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    named = rows.select(F.col("vec_id").alias("row"), "vec_id", F.lit(0).alias("cell"), "v")
    true = named.mapInArrow(_scan(queries, k), "n int, vec_id long, cell int, score double").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = vectors.sparkSession.createDataFrame([(n, q) for n, (q, _) in enumerate(queries)], "n int, query_id long")
    hit = true.join(F.broadcast(ids), "n").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
