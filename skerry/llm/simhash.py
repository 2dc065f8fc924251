"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of the
segments' bit counts.  Written in unary within each segment (00, 01, 11) the embedding is a 64-bit
word again, and the Manhattan distance of two embeddings is the number of differing bits of these
words.  It is never above the Hamming distance of the fingerprints, since a segment's counts differ
by no more than its bits do.

Grid: the vector is cut into ``groups`` groups of coordinates.  If the Manhattan distance is at most
4, all but four groups agree entirely, so two linked fingerprints share the grid cell of at least
one choice of ``groups - 4`` groups.  The range join is an equality join on these cells; within a
cell the Manhattan bound is applied first and then the fingerprints compared.

Only distinct fingerprints take part, so exact copies cost nothing.  A cell is never expanded into
its pairs: large cells are walked from link to link, which gives at most one link for each fingerprint
reached and compares a fingerprint only with those not reached yet.  That keeps the components of
each cell, and so those of the whole.  Cells of over ``hot_cell`` fingerprints are cut into blocks,
and each pair of blocks is a cell of its own, so a task's walk is bounded whatever a cell holds.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and is linked
like any other; rows with a null identifier take part, component_id is the least identifier that is
not null (null if there is none); repeated rows are rows of one fingerprint; an empty table gives
an empty result; further columns are ignored (:func:`keep_representatives` keeps them, whatever their
names); a text of any length is worked on as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry import workspace
from skerry.llm import _arrow
from skerry.llm._columns import unused
from skerry.llm.components import connected_components

SEED = 42
SHINGLE = 4
DISTANCE = 4
SEGMENTS = 32
HOT_CELL = 1 << 17
SMALL_CELL = 24
BROADCAST_ROWS = 262_144
# The low bit of each two-bit segment, as a signed 64-bit number.
_LOW = 0x5555555555555555


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``size`` words of the lower-cased text, repeats included."""
    words = text.lower().split()  # of bytes: A-Z; white space as the contract has it
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[: len(words) - size + 1] - np.array([len(w) + 1 for w in words[: len(words) - size + 1]])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], dtype=np.uint64)


def _fingerprint(hashes: np.ndarray, chunk: int = 1 << 15) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), chunk):
        part = hashes[k : k + chunk].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _arrow.text_slices(batches):
        prints = [_fingerprint(shingle_hashes(t)) for t in texts]
        yield part.drop_columns(["text"]).append_column("fp", pa.array(prints, pa.int64()))


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints_of, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the segments, in unary within each segment."""
    low = F.lit(_LOW)
    up = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(up).bitwiseAND(low)
    both = fp.bitwiseAND(up).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _embedding(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW), np.uint64(1)
    return ((fp | fp >> one) & low) | ((fp & fp >> one & low) << one)


def grid_masks(groups: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of ``groups - distance`` groups, the bits of the embedding that it fixes."""
    cuts = [round(k * SEGMENTS / groups) for k in range(groups + 1)]
    part = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(part[g] for g in chosen) for chosen in combinations(range(groups), groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def groups_for(rows: int, distance: int = DISTANCE) -> int:
    """Groups that let a fingerprint meet few others by chance; any number gives the same links."""
    for groups in range(distance + 2, distance + 7):
        masks = grid_masks(groups, distance)
        if rows * sum(0.375 ** (bin(m & (1 << 64) - 1).count("1") / 2) for m in masks) < 200:
            return groups
    return distance + 6


def _links(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within sorted cells that join the same fingerprints as all links do."""
    left, right = [], []
    em = _embedding(fp)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    size_of = np.repeat(sizes, sizes)
    small = size_of <= SMALL_CELL
    for d in range(1, min(SMALL_CELL, int(sizes.max(initial=1)))):
        at = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:])
        if not len(at):
            break
        at = at[np.bitwise_count(em[at] ^ em[at + d]) <= distance]
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        left.append(fp[at])
        right.append(fp[at + d])
    for s, n in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
        rest_fp, rest_em = fp[s : s + n], em[s : s + n]
        todo: list = []
        while len(rest_fp):
            if not todo:
                todo.append((rest_fp[0], rest_em[0]))
                rest_fp, rest_em = rest_fp[1:], rest_em[1:]
                continue
            at_fp, at_em = todo.pop()
            near = np.bitwise_count(rest_em ^ at_em) <= distance
            near[near] = np.bitwise_count(rest_fp[near] ^ at_fp) <= distance
            if near.any():
                found = rest_fp[near]
                left.append(np.full(len(found), at_fp))
                right.append(found)
                todo.extend(zip(found, rest_em[near]))
                rest_fp, rest_em = rest_fp[~near], rest_em[~near]
    return left, right


def _walk(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(cell) > 1:
                left, right = _links(cell, fp, distance)
                if left and sum(map(len, left)):
                    a, b = (np.concatenate(x).view(np.int64) for x in (left, right))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cell = np.concatenate([held_cell, np.asarray(batch.column("cell"))])
            fp = np.concatenate([held_fp, np.asarray(batch.column("fp")).view(np.uint64)])
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            yield from out(cell[:cut], fp[:cut])
            held_cell, held_fp = cell[cut:], fp[cut:]
        yield from out(held_cell, held_fp)

    return run


def near_links(prints: DataFrame, *, distance: int = DISTANCE, groups: int | None = None, hot_cell: int = HOT_CELL) -> DataFrame:
    """(a, b) links among the distinct ``fp`` of ``prints`` with the components of all links."""
    rows = prints.count()
    masks = grid_masks(groups or groups_for(rows, distance), distance)
    cells = prints.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), embedding(F.col("fp")).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("cell"))
    if rows > hot_cell:
        hot = cells.groupBy("cell").count().filter(F.col("count") > hot_cell).select("cell", F.ceil(2 * F.col("count") / hot_cell).alias("blocks"))
        hot = workspace.materialize(hot, "simhash-hot")  # at most len(masks) * rows / hot_cell rows
        cells = cells.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "cell", "left").withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(3)), F.coalesce("blocks", F.lit(1))))
        pair = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least(o, F.col("mine")), F.greatest(o, F.col("mine")))))
        cells = cells.select("fp", F.explode(pair).alias("cell"))
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.select("cell", "fp").mapInArrow(_walk(distance), "a long, b long")


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE, groups: int | None = None, hot_cell: int = HOT_CELL, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fp, component_id: one row per document."""
    prints = workspace.materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash-prints")
    distinct = workspace.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    links = near_links(distinct.select("fp"), distance=distance, groups=groups, hot_cell=hot_cell)
    # Most fingerprints are linked to none and keep their own identifier; the others meet by component.
    component = workspace.materialize(connected_components(links), "simhash-nodes")
    named = distinct.join(component, F.col("fp") == F.col("node"), "left").select("fp", "rep", "component")
    named = workspace.materialize(named, "simhash-named")
    linked = named.filter("component is not null")
    # Written before it is joined: between two scans, adaptive execution may split a component that many share.
    least = workspace.materialize(linked.groupBy("component").agg(F.min("rep").alias("component_id")), "simhash-least")
    by_print = linked.join(least, "component").select("fp", "component_id")
    by_print = workspace.materialize(by_print.union(named.filter("component is null").select("fp", "rep")), "simhash-components")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of ``docs`` whose identifier is the least of their component; rows without one stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = workspace.materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "simhash-gone")
    small = gone.count() <= BROADCAST_ROWS  # 8-byte identifiers, some 10 MB at most; beyond that a shuffled join
    name = unused(docs.columns, "gone_id")
    gone = gone.withColumnRenamed("gone_id", name)
    return docs.join(F.broadcast(gone) if small else gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
