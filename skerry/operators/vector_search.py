"""Exact top-k by cosine, and the offline hash embedding.

``native`` keeps a few queries' work in the JVM; ``block`` multiplies Arrow batches of vectors with the query
matrix and sends only each task's best on, scored exactly.  Queries are broadcast in blocks of at most
``QUERY_BLOCK``; more queries are more passes over the items, one after another.  Ties go to the smaller item.
:mod:`skerry.operators.cell_index` skips what can't be among the best, and takes any number of queries.

At every size, by every method: a vector that is null, or holds a null, NaN or an infinite number, neither
asks nor is found; a zero vector has the score 0 with all; identifiers may be of any type that can be ordered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import workspace

QUERY_BLOCK = 4096
NATIVE_QUERIES = 64  # beyond, products of matrices take less than pairs in the JVM
SCORED_PAIRS = 1 << 22  # scores in memory at once, of four bytes
EXACT_PAIRS = 1 << 16
DIMENSIONS = 64
EMBEDDED_ROWS = 1024  # texts whose tokens are in memory at once
EMBEDDED_BYTES = 1 << 20
NO_WORD = r"[^\p{L}\p{N}]+"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def ranked(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """rank and the best ``k`` by score of each query; planned as a partial and a final group limit."""
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vectors can be compared."""
    return rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: F.abs(x) < F.lit(float("inf"))))


def topk_native(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, vector), (item_id, vector): query_id, item_id, score, rank.

    Up to ``NATIVE_QUERIES`` queries are broadcast; more go the way of :func:`topk_block`, with the same results.
    """
    queries, items = usable(queries), usable(items)
    if queries.limit(NATIVE_QUERIES + 1).count() > NATIVE_QUERIES:
        return topk_block(queries, items, k, exclude_self)
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("qv"))
    q = q.withColumn("qn", _dot(F.col("qv"), F.col("qv")))
    d = items.select("item_id", F.col("vector").cast("array<double>").alias("dv"))
    d = d.withColumn("dn", _dot(F.col("dv"), F.col("dv")))
    pairs = d.crossJoin(F.broadcast(q))
    if exclude_self:
        pairs = pairs.filter(F.col("query_id").cast("string") != F.col("item_id").cast("string"))
    norm = F.sqrt(F.col("qn") * F.col("dn"))
    score = F.when(norm > 0, _dot(F.col("qv"), F.col("dv")) / norm).otherwise(0.0)
    return ranked(pairs.select("query_id", "item_id", score.alias("score")), k)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up from the first coordinate to the last, as :func:`_dot` does: the same bits."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _units(x: np.ndarray, square: np.ndarray) -> np.ndarray:
    length = np.sqrt(square)
    return (x / np.where(length > 0, length, np.inf)[:, None]).astype(np.float32)


class Best:
    """Each query's best ``k`` of the items shown so far, by exact score; equal scores go to the smaller item.

    Products of unit vectors in single precision tell which pairs can be among the best; only these are
    scored exactly, and what a query has found already bounds what comes after.
    """

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.vectors, self.k, self.exclude_self = ids, vectors, k, exclude_self
        self.square = _sums(vectors, vectors)
        self.unit = _units(vectors, self.square)
        self.slack = (vectors.shape[1] + 8) * 2.0**-23  # twice what rounding can do
        self.least = np.full(len(ids), -2.0)  # the k-th score of each query, once it has so many
        self.held: pa.Table | None = None

    def show(self, items: pa.Array, x: np.ndarray) -> None:
        rows = max(self.k + 1, SCORED_PAIRS // max(len(self.ids), 1))
        for start in range(0, len(items), rows):
            self._show(items.slice(start, rows), x[start : start + rows])

    def _show(self, items: pa.Array, x: np.ndarray) -> None:
        square, k = _sums(x, x), self.k
        near = self.unit @ _units(x, square).T
        if self.exclude_self:
            mine, theirs = (self.ids, items) if self.ids.type == items.type else (self.ids.cast(pa.string()), items.cast(pa.string()))
            same = pc.index_in(theirs, value_set=mine)
            at = np.flatnonzero(np.asarray(same.is_valid()))
            near[np.asarray(same.take(pa.array(at))), at] = -np.inf
        least = self.least - self.slack
        if k < near.shape[1] and (self.least == -2).any():
            least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k].astype(np.float64) - 2 * self.slack)
        rows, at = np.nonzero(near >= least.astype(np.float32)[:, None])
        if not len(rows):
            return
        score = np.empty(len(rows))
        for i in range(0, len(rows), EXACT_PAIRS):
            r, c = rows[i : i + EXACT_PAIRS], at[i : i + EXACT_PAIRS]
            scale = np.sqrt(self.square[r] * square[c])
            score[i : i + EXACT_PAIRS] = np.divide(_sums(self.vectors[r], x[c]), scale, out=np.zeros(len(r)), where=scale > 0)
        found = pa.table({"row": rows, "score": score, "item": items.take(pa.array(at))}).filter(pc.is_finite(pa.array(score)))
        both = found if self.held is None else pa.concat_tables([self.held, found])
        both = both.sort_by([("row", "ascending"), ("score", "descending"), ("item", "ascending")])
        row = both.column("row").to_numpy()
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.held = both.filter(pa.array(place < k)).combine_chunks()
        last = place == k - 1
        self.least[row[last]] = both.column("score").to_numpy()[last]

    def found(self, kind: pa.DataType) -> pa.RecordBatch:
        """query_id, item_id, score."""
        held = self.held if self.held is not None else pa.table({"row": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "item": pa.array([], kind)})
        row, score, item = (held.column(c).combine_chunks() for c in ("row", "score", "item"))
        return pa.RecordBatch.from_arrays([self.ids.take(row), item, score], names=["query_id", "item_id", "score"])


def best_of(ids: pa.Array, vectors: np.ndarray, items: pa.Array, x: np.ndarray, k: int, exclude_self: bool) -> pa.RecordBatch:
    """query_id, item_id, score of each query's best ``k`` items."""
    best = Best(ids, vectors, k, exclude_self)
    best.show(items, x)
    return best.found(items.type)


def matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(lists.flatten()).astype(np.float64).reshape(rows, -1 if rows else 0)


def _best_of_batches(ids: pa.Array, vectors: np.ndarray, k: int, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(ids, vectors, k, exclude_self), None
        for batch in batches:
            if batch.num_rows:
                kind = batch.column("item_id").type
                best.show(batch.column("item_id"), matrix(batch.column("vector"), batch.num_rows))
        if kind is not None:
            yield best.found(kind)

    return run


def topk_block(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """As :func:`topk_native` with matrix products.

    One block of queries is on the driver at a time: with more than one, the best of each are written
    before the next block is asked.
    """
    asked = usable(queries).select("query_id", F.col("vector").cast("array<double>"))
    first = asked.limit(QUERY_BLOCK + 1).toArrow()  # all queries, unless they are more than a block
    blocks = min(first.num_rows, 1) if first.num_rows <= QUERY_BLOCK else -(-asked.count() // QUERY_BLOCK)
    rows = usable(items).select("item_id", F.col("vector").cast("array<double>"))
    # Few bytes, much work: all cores get a share of the items, however few files these come in.
    rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "item_id")
    kinds = [asked.schema["query_id"].dataType.simpleString(), rows.schema["item_id"].dataType.simpleString()]
    if not blocks:
        none = rows.sparkSession.createDataFrame([], f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
        return ranked(none, k)
    out = None
    for b in range(blocks):
        table = first if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # a block of queries
        if not table.num_rows:
            continue
        ids, vectors = (table.column(c).combine_chunks() for c in range(2))
        scored = rows.mapInArrow(_best_of_batches(ids, matrix(vectors, len(ids)), k, exclude_self), f"query_id {kinds[0]}, item_id {kinds[1]}, score double")
        best = ranked(scored, k)
        if blocks > 1:
            best = workspace.materialize(best, "top-k")
        out = best if out is None else out.union(best)
    return out


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NO_WORD), lambda t: t != "")


@lru_cache(1 << 16)
def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % DIMENSIONS if token else -1


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with EMBEDDED_ROWS texts and EMBEDDED_BYTES at most; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        limit = (ends[start - 1] if start else 0) + EMBEDDED_BYTES
        end = min(max(start + 1, int(np.searchsorted(ends, limit, side="right"))), start + EMBEDDED_ROWS)
        yield batch.slice(start, end - start)
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _slices(whole):
            words = pc.split_pattern_regex(batch.column("text"), NO_WORD)
            distinct = pc.dictionary_encode(words.flatten())
            buckets = np.array([_bucket(w) for w in distinct.dictionary.to_pylist()], dtype=np.int64)[distinct.indices.to_numpy()]
            cells = pc.list_parent_indices(words).to_numpy() * DIMENSIONS + buckets
            counts = np.bincount(cells[buckets >= 0], minlength=batch.num_rows * DIMENSIONS).astype(np.float64)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * DIMENSIONS)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(ends, pa.array(counts))], names=["item_id", "vector"])


def hash_embedding(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(item_id, vector): counts of tokens in buckets by a hash prefix, as whole numbers; one row per row, without a shuffle.

    Whole counts make dot products exact and independent of their order.  A null text is an empty one,
    whose vector is zero.  Batches of Arrow take half the time of a JVM plan that explodes and counts
    tokens, as each distinct token of a slice is hashed once.
    """
    texts = rows.select(F.col(id_col).cast("long").alias("item_id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    return texts.mapInArrow(_counted, "item_id long, vector array<double>")
