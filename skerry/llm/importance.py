"""Target-distribution importance resampling, with overlap chunking of long texts.

Features are the runs of one to ``n`` consecutive words, hashed into buckets by CRC-32.  A bucket's gain
is the logarithm of its share in the target over its share in the documents; a document's weight is the
mean gain of its features, and those with the highest weights plus Gumbel noise (a hash of the
identifier) are drawn: a sample without replacement in proportion to the weights.

A text over ``chunk_bytes`` is cut at word boundaries into chunks that own the words starting in them and
carry the next ``n - 1`` words along, so each feature is counted by exactly one chunk.  The chunks are
written once, spread over partitions by chunk, and both passes (bucket counts, weights) read them from
there: no task works through a whole long text, and a document's counts and gains are sums over its chunks.
Shorter texts are whole in their own row and need no shuffle.

Words are runs of a-z (A-Z lower-cased), 0-9 and bytes from 0x80 on.  The driver holds a number per
bucket.  Ranks come from :mod:`skerry.operators.ordering`.

Defined results: a null text has no words; a text without words has no features and weight 0; texts with
fewer than ``least_words`` words are scored but never drawn; a null identifier is hashed as an empty one and
comes after all others of its score; rows with equal identifiers are ranked next to each other where they
tie, in any order; repeated rows are separate documents; a null target text counts nothing; an empty table
of documents gives an empty result, an empty target flat gains; further columns are ignored by
:func:`scored` and :func:`ranked` and kept by :func:`drawn`, whatever their names; texts of any length count as a whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry import workspace
from skerry.llm import _arrow
from skerry.llm._arrow import Words, segment_sums
from skerry.llm._columns import unused
from skerry.operators import ordering

RUN = 2
BUCKETS = 10_000
SHARE = 25  # percent of the documents long enough
LEAST_WORDS = 20
SEED = 7
CHUNK_BYTES = 1 << 16

# The bytes of words are digits, letters a-z and all from 0x80 on.
_WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[_WORD_BYTES] = False
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

_SHORT = 32  # words up to so many bytes are hashed together, byte by byte


def _crc_table() -> np.ndarray:
    """CRC-32 of the polynomial 0xEDB88320, reflected: the change of each low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _zeros(tables: np.ndarray) -> np.ndarray:
    """What one more zero byte makes of the entries of ``tables``."""
    return _CRC[tables & np.uint32(0xFF)] ^ (tables >> np.uint32(8))


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The effect of 0 to _SHORT further bytes, and of powers of two of them, on each byte of a CRC."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    by_length = [one]
    for _ in range(_SHORT):
        by_length.append(_zeros(by_length[-1]))
    powers = [by_length[1]]
    for _ in range(31):
        last = powers[-1]
        powers.append(_apply(last, last))
    return np.stack(by_length), powers


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint32(0xFF)]
    for k in range(1, 4):
        out = out ^ tables[k][crc >> np.uint32(8 * k) & np.uint32(0xFF)]
    return out


_BY_LENGTH, _POWERS = _shift_tables()


def _shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs as they count before ``lengths`` more bytes."""
    few = np.minimum(lengths, _SHORT)
    out = _BY_LENGTH[few, 0, crc & np.uint32(0xFF)]
    for k in range(1, 4):
        out = out ^ _BY_LENGTH[few, k, crc >> np.uint32(8 * k) & np.uint32(0xFF)]
    more = np.flatnonzero(lengths > _SHORT)
    if len(more):
        rest, value = lengths[more], crc[more]
        for bit in range(int(rest.max()).bit_length()):
            on = rest >> bit & 1 == 1
            value[on] = _apply(_POWERS[bit], value[on])
        out[more] = value
    return out


def word_crcs(words: Words) -> np.ndarray:
    """CRC-32 of each word's bytes."""
    lengths = words.ends - words.starts
    order = np.argsort(-np.minimum(lengths, _SHORT + 1).astype(np.int16), kind="stable")  # longest first
    long = int(np.count_nonzero(lengths > _SHORT))
    out = np.zeros(len(lengths), dtype=np.uint32)
    for k in order[:long]:
        out[k] = zlib.crc32(words.raw[words.starts[k] : words.ends[k]])
    order = order[long:]
    starts, ascending = words.starts[order], -lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(int(-ascending[0]) if len(order) else 0):
        n = int(np.searchsorted(ascending, -j, side="left"))  # so many have a byte there
        crc[:n] = _CRC[(crc[:n] ^ words.data[starts[:n] + j]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out[order] = ~crc
    return out


def features(words: Words, owned: np.ndarray, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ``run`` words: (place of the first word, CRC-32 of the words joined by a space).

    ``owned`` says which words may come first; a run ends within its text.
    """
    crcs, lengths = word_crcs(words), words.ends - words.starts
    last = np.repeat(words.bounds[1:], words.counts)  # where the text of each word ends
    first = np.flatnonzero(owned)
    now = crcs[first]
    for k in range(run):
        if k:
            inside = first + k < last[first]
            first, now = first[inside], now[inside]
            raw = ~now
            spaced = ~(_CRC[(raw ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (raw >> np.uint32(8)))
            now = _shifted(spaced, lengths[first + k]) ^ crcs[first + k]
        yield first, now


def _owned(words: Words, own: np.ndarray) -> np.ndarray:
    """Words that start among the first ``own`` bytes of their text (-1: all)."""
    of = np.repeat(np.arange(len(words.counts)), words.counts)
    return (own[of] < 0) | (words.starts - words.text_starts[of] < own[of])


def _cut(run: int, most: int):
    """Chunks of long texts: row, doc_id, chunk, own, text."""

    def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
        begin = 0
        while begin < len(text):
            end = begin + most
            if end >= len(text):
                yield -1, text[begin:]
                return
            found = _BREAK.search(text, end)  # the word that stands at the limit belongs to this chunk
            end = found.start() if found else len(text)
            carried = end
            for _ in range(run - 1):
                found = _WORD.search(text, carried)
                carried = found.end() if found else len(text)
            yield end - begin, text[begin:carried]
            begin = end

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                held, size = [], 0
                for k, (own, part) in enumerate(pieces(text)):
                    held.append((row, doc_id, k, own, part))
                    size += len(part)
                    if size > 32 * most:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _CHUNK_TYPES)], names=_CHUNK_NAMES)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _CHUNK_TYPES)], names=_CHUNK_NAMES)

    return work


_CHUNK_NAMES = ["row", "doc_id", "chunk", "own", "text"]
_CHUNK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _parts(docs: DataFrame, id_col: str, text_col: str, run: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(texts that are one part, chunks of the others): doc_id, own, text and, of chunks, row and chunk."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = rows.filter(size <= chunk_bytes).select("doc_id", F.lit(-1).cast("long").alias("own"), "text")
    long = rows.filter(size > chunk_bytes).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.encode("text", "UTF-8").alias("text"))
    chunks = long.mapInArrow(_cut(run, chunk_bytes), "row long, doc_id long, chunk long, own long, text binary")
    return short, workspace.materialize(chunks.repartition("row", "chunk"), "resampling-chunks")


def _counting(run: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part, texts in _arrow.text_slices(batches):
            words = Words(texts, separators=SEPARATORS)
            for _, crc in features(words, _owned(words, np.asarray(part.column("own"))), run):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[bucket])], names=["bucket", "n"])

    return work


def bucket_counts(parts: list[DataFrame], run: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; each task adds its own up, the driver gets a number per bucket."""
    out = np.zeros(buckets, dtype=np.int64)
    counted = None
    for rows in parts:
        one = rows.select("own", "text").mapInArrow(_counting(run, buckets), "bucket long, n long")
        counted = one if counted is None else counted.unionByName(one)
    table = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(table.column("bucket"))] = np.asarray(table.column("n"))
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """1000 times the log of a bucket's share in the target over that in the documents, each count plus one, rounded down."""
    t_all, s_all, n = float(target.sum()), float(raw.sum()), float(len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in zip(target.tolist(), raw.tolist())], dtype=np.int64)


def _weighing(gain: np.ndarray, run: int):
    """As rows of numbers: what each part owns of words and features, and the sum of their gains."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _arrow.text_slices(batches):
            words = Words(texts, separators=SEPARATORS)
            owned = _owned(words, np.asarray(part.column("own")))
            count, total = np.zeros(len(owned), dtype=np.int64), np.zeros(len(owned), dtype=np.int64)
            for first, crc in features(words, owned, run):
                count[first] += 1
                total[first] += gain[crc % np.uint32(len(gain))]
            sums = [segment_sums(x, words.bounds) for x in (owned.astype(np.int64), count, total)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *map(pa.array, sums)], names=["row", "doc_id", "n_words", "n_features", "gain"])

    return work


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times Gumbel noise, rounded down, from the first 32 bits of a digest of seed and identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, target: DataFrame, *, id_col="doc_id", text_col="text", target_col="text", run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: one row per document."""
    short, chunks = _parts(docs, id_col, text_col, run, chunk_bytes)
    wanted, wanted_chunks = _parts(target.select(F.lit(0).alias("no_id"), F.col(f"`{target_col}`").alias("text")), "no_id", "text", run, chunk_bytes)
    gain = gains(bucket_counts([wanted, wanted_chunks], run, buckets), bucket_counts([short, chunks], run, buckets))
    workspace.release(wanted_chunks)
    schema = "row long, doc_id long, n_words long, n_features long, gain long"
    whole = short.withColumn("row", F.lit(-1).cast("long")).mapInArrow(_weighing(gain, run), schema)
    parts = chunks.select("row", "doc_id", "own", "text").mapInArrow(_weighing(gain, run), schema)
    summed = parts.groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    every = workspace.materialize(whole.unionByName(summed).drop("row"), "resampling-weights")
    workspace.release(chunks)
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    every = every.select("doc_id", "n_words", "n_features", weight.alias("weight"))
    return every.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(docs: DataFrame, target: DataFrame, *, share: int = SHARE, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """:func:`scored` with ``rank``: 1, 2, 3 … for the drawn ones, null for the rest."""
    every = workspace.materialize(scored(docs, target, **options), "resampling-scores")
    long_enough = every.filter(F.col("n_words") >= least_words)
    draw = long_enough.count() * share // 100
    placed = ordering.numbered(long_enough, [F.desc("score"), F.asc_nulls_last("doc_id")], "rank", 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return placed.unionByName(every.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, *, id_col="doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs``, with their columns.

    Where identifiers repeat or are null, rows are numbered in a written table and drawn by their numbers.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(f"`{id_col}`")).alias("ids")).first()
    columns, key = docs.columns, id_col
    if ids["rows"] != ids["ids"]:
        key = unused(columns, "draw_row")
        docs = workspace.materialize(docs.withColumn(key, F.monotonically_increasing_id()), "resampling-numbered")
    found = ranked(docs, target, id_col=key, **options).filter("rank is not null")
    mine = unused(columns, "drawn_id")
    found = found.select(F.col("doc_id").alias(mine))
    return docs.join(found, F.col(f"`{key}`").cast("long") == F.col(mine), "left_semi").select(*[F.col(f"`{c}`") for c in columns])
