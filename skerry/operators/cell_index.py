"""An inverted file of vectors whose top k by cosine is exact.

Building: centres come of a bounded sample; every vector, scaled to length one, goes to its nearest
centre and keeps its distance from it.  Vectors of a cell, in the order of that distance, are cut into
blocks, of which a row each is known: cell, vectors, least and greatest distance from the centre.

Searching: a vector at distance ``d`` from the centre is at least ``|d(query, centre) - d|`` away from the
query (triangle inequality).  A query first reads its most promising blocks, until they hold ``k`` vectors; the
k-th score found bounds all the rest, and only blocks that could hold a better one are read then.  What
isn't read is proved to be out, so the hits are those of a search over everything.

Queries are rows: each is joined to the blocks it reads, and a task multiplies one block with the queries that
read it.  Zero vectors are a cell of their own, whose score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry import workspace
from skerry.operators import ordering
from skerry.operators.vector_search import QUERY_BLOCK, best_of, matrix, ranked, usable

SAMPLE_ROWS = 20_000
MOST_CELLS = 1_024
BLOCK_ROWS = 2_048
#: Blocks known to every task, a row of 32 bytes each; larger collections have larger blocks.
MOST_BLOCKS = 100_000
ITERATIONS = 8
#: Distances are computed to about 1e-8; blocks this much farther than the bound are still read.
SLACK = 1e-7
_ZERO_CELL = -1


def centres_of(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by Lloyd's iterations from a random start; an empty one stays where it was."""
    cells = min(cells, len(sample))
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ITERATIONS if cells else 0):
        nearest = _distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        n = np.bincount(nearest, minlength=cells)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None]


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector"), batch.num_rows)
                zero = ~x.any(1)
                far = _distances(_units(x), centres) if len(centres) else np.zeros((len(x), 1))
                cell = np.where(zero, _ZERO_CELL, far.argmin(1))
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(np.where(zero, 0.0, far.min(1)))], names=["item_id", "vector", "cell", "far"])

    return run


@dataclass(frozen=True)
class Known:
    """What every task knows of an index."""

    centres: np.ndarray
    blocks: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each query and block a distance of unit vectors that no vector of the block is nearer than."""
        unit = _units(x)
        centre = _distances(unit, self.centres) if len(self.centres) else np.zeros((len(x), 1))
        d = centre[:, np.maximum(self.blocks["cell"], 0)]
        bound = np.maximum(0, np.maximum(d - self.blocks["far"], self.blocks["near"] - d))
        bound[:, self.blocks["cell"] == _ZERO_CELL] = np.sqrt(2)  # the score is 0
        bound[~x.any(1)] = np.sqrt(2)
        return bound


class CellIndex:
    """(item_id, vector) dealt to cells and blocks; see :meth:`build` and :meth:`search`."""

    def __init__(self, spark: SparkSession, items: DataFrame, known: Known):
        self.spark, self.items, self.known = spark, items, known

    @classmethod
    def build(cls, items: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, seed: int = 7) -> CellIndex:
        """Index every row; ``sample_rows`` of them, by a hash of their identifiers, serve to find the centres."""
        spark = items.sparkSession
        rows = usable(items).select("item_id", F.col("vector").cast("array<double>"))
        n = rows.count()
        share = min(1.0, 1.2 * sample_rows / max(n, 1))
        place = F.pmod(F.xxhash64(F.lit(seed), F.col("item_id").cast("string")), F.lit(1 << 30))
        sample = rows.filter(place < int(share * (1 << 30))).limit(sample_rows).select("vector").toArrow()  # sample_rows vectors at most
        x = matrix(sample.column(0).combine_chunks(), sample.num_rows) if sample.num_rows else np.zeros((0, 1))
        x = _units(x[x.any(1)])
        centres = centres_of(x, cells or min(MOST_CELLS, max(1, round(len(x) ** 0.5))), seed)
        kind = rows.schema["item_id"].dataType.simpleString()
        dealt = workspace.materialize(rows.mapInArrow(_assigned(centres), f"item_id {kind}, vector array<double>, cell int, far double"), "cells")
        size = max(block_rows, -(-n // MOST_BLOCKS))
        placed = ordering.numbered(dealt, ["cell", "far", F.col("item_id")], "number").withColumn("block", F.expr(f"number div {size}"))
        placed = workspace.materialize(placed.select("item_id", "vector", "cell", "block", "far"), "blocks")
        workspace.release(dealt)
        known = placed.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).orderBy("cell", "block").toArrow()  # MOST_BLOCKS rows and one for each cell at most
        blocks = np.array([tuple(r.values()) for r in known.to_pylist()], dtype=[("cell", "i4"), ("block", "i8"), ("n", "i8"), ("near", "f8"), ("far", "f8")])
        return cls(spark, placed.drop("far"), Known(centres, blocks))

    def _planned(self, k: int, after: bool):
        """The blocks that each query reads: first the nearest with ``k`` vectors, then all others that may be better than the worst hit."""
        known = self.known

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    bound = known.bounds(matrix(batch.column("vector"), batch.num_rows))
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.cumsum(known.blocks["n"][order], axis=1) - known.blocks["n"][order]
                    first = before < k
                    if after:
                        limit = np.asarray(batch.column("limit"))[:, None]
                        chosen = ~first & (np.take_along_axis(bound, order, 1) <= limit + SLACK)
                    else:
                        chosen = first
                    rows, at = np.nonzero(chosen)
                    picked = known.blocks[order[rows, at]]
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("vector").take(take), pa.array(picked["cell"]), pa.array(picked["block"])], names=["query_id", "vector", "cell", "block"])

        return run

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """query_id, item_id, score, rank, as :func:`skerry.operators.vector_search.topk_block` gives them."""
        hits, _ = self.searched(queries, k, exclude_self)
        return hits

    def searched(self, queries: DataFrame, k: int, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
        """The hits, and (query_id, cell, block) of what was read for them."""
        asked = workspace.materialize(usable(queries).select("query_id", F.col("vector").cast("array<double>")), "asked")
        kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((asked, "query_id"), (self.items, "item_id")))
        plan = f"query_id {kind}, vector array<double>, cell int, block long"
        parts = -(-asked.count() // QUERY_BLOCK)  # so that a block meets a bounded number of queries at a time
        wanted = k + 1 if exclude_self else k

        def scored(pairs: DataFrame) -> DataFrame:
            def work(left: pa.Table, right: pa.Table) -> pa.Table:
                if not left.num_rows or not right.num_rows:
                    return pa.table([pa.array([], t) for t in (left.schema.field("query_id").type, right.schema.field("item_id").type, pa.float64())], names=["query_id", "item_id", "score"])
                ids, vectors, items, x = (c.combine_chunks() for c in (left.column("query_id"), left.column("vector"), right.column("item_id"), right.column("vector")))
                return pa.Table.from_batches([best_of(ids, matrix(vectors, len(ids)), items, matrix(x, len(items)), k, exclude_self)])

            part = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(max(parts, 1)))
            mine = pairs.withColumn("part", part)
            # Blocks that no query reads aren't shuffled; the others come once for each part of the queries.
            wanted_blocks = mine.select("cell", "block", "part").distinct()
            read = self.items.join(wanted_blocks, ["cell", "block"]).select(F.col("cell").alias("of_cell"), F.col("block").alias("of_block"), F.col("part").alias("of_part"), "item_id", "vector")
            return mine.groupBy("cell", "block", "part").cogroup(read.groupBy("of_cell", "of_block", "of_part")).applyInArrow(work, f"query_id {kind}, item_id {item_kind}, score double")

        first = workspace.materialize(asked.mapInArrow(self._planned(wanted, False), plan), "first-blocks")
        hits = workspace.materialize(scored(first), "first-hits")
        # The distance of unit vectors with the k-th score; where fewer hits were found, anything may be better.
        worst = ranked(hits, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
        limit = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0)))).otherwise(F.lit(3.0))
        bounded = asked.join(worst, "query_id", "left").select("query_id", "vector", F.coalesce(limit, F.lit(3.0)).alias("limit"))
        more = workspace.materialize(bounded.mapInArrow(self._planned(wanted, True), plan), "further-blocks")
        out = ranked(hits.unionByName(workspace.materialize(scored(more), "further-hits")), k)
        return out, first.unionByName(more).select("query_id", "cell", "block")
