"""Packing token sequences by shortest-pack-first over the length histogram.

A document's tokens are its text's ids and one end id.  Documents longer than a sequence are cut at
multiples of the sequence length; the pieces' lengths make a histogram with one bin per length, so
its size doesn't depend on the input.  Lengths are placed longest first into the open pack that is
shortest, which updates pattern counts; pieces are then joined to the patterns by their rank among
the pieces of their length.

Ranks come from a prefix sum over hash buckets and a rank within each, so that a length that a third
of all pieces share is spread over many tasks.

Tokens: the bytes of a batch are cut into the tokenizer's pre-tokens with array operations and
dictionary-encoded; each new pre-token is encoded once per worker.  Words with characters beyond
Latin-1, for which cutting might depend on Unicode versions or normal forms, go to the tokenizer as
they are, also once per worker.

Defined results: a null or empty text has one token, the end id; repeated rows are separate
documents; an empty table gives an empty result; further columns are ignored; a text of any length is
tokenized as a whole, within a task's memory.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import workspace

SEQUENCE = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PIECES_PER_BUCKET = 20_000

_CACHE_PARTS = 400_000  # of some 200 bytes each, in each Python worker
_SLICE_BYTES = 2 << 20

_BLANK, _LETTER, _NUMBER, _MARK, _OTHER = range(5)

# How the tokenizer's pattern classes the code points up to 255.  Code points that it
# might treat otherwise (controls, other blanks) and all later ones are _OTHER.
_KINDS = np.full(256, _OTHER, dtype=np.uint8)
_KINDS[0x21:0x7F] = _MARK
_KINDS[0xA1:] = _MARK
_KINDS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KINDS[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_CONTRACTIONS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
_SEPARATOR = "\N{TROPHY}"

_BYTE_KINDS = np.where(np.arange(256) < 0x80, _KINDS, _OTHER).astype(np.uint8)
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def cut_parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without blanks, part starts in them, part starts in ``raw``, whether a part is an odd word).

    ``raw`` is UTF-8 that ends with a blank.  Words of Latin-1 characters are lower-cased and cut
    into the tokenizer's pre-tokens; an odd word, which has other characters, stays one part as it is.
    """
    kind, data = _BYTE_KINDS[raw], _LOWER[raw]
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
    lead = lead[(raw[lead + 1] & 0xC0) == 0x80]
    follow = raw[lead + 1]
    kind[lead] = kind[lead + 1] = _KINDS[((raw[lead] & 3) << 6) | (follow & 0x3F)]
    capital = lead[(raw[lead] == 0xC3) & (follow < 0x9F) & (follow != 0x97)]
    data[capital + 1] += 0x20
    solid = kind != _BLANK
    start = solid.copy()
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    start[lead + 1] = False
    quote = np.flatnonzero((raw == 0x27) & start)
    if len(quote):
        after = [data[np.minimum(quote + k, len(data) - 1)] for k in (1, 2)]
        for letters in _CONTRACTIONS:
            found = quote[np.logical_and.reduce([after[k] == c for k, c in enumerate(letters)])]
            start[found + 1] = False
            rest = found + 1 + len(letters)
            start[rest[kind[rest] == _LETTER]] = True
    within = None
    if (kind == _OTHER).any():
        edge = np.flatnonzero(np.diff(solid, prepend=False))
        first, last = edge[0::2], edge[1::2]
        odd = np.unique(np.searchsorted(first, np.flatnonzero(kind == _OTHER), side="right") - 1)
        step = np.zeros(len(raw), dtype=np.int8)
        step[first[odd]] = 1
        step[last[odd]] = -1
        within = np.cumsum(step, dtype=np.int8).astype(bool)
        start &= ~within
        start[first[odd]] = True
        data = np.where(within, raw, data)
    at = np.flatnonzero(start)
    return data[solid], np.flatnonzero(start[solid]), at, np.zeros(len(at), dtype=bool) if within is None else within[at]


class TextEncoder:
    """Ids of texts; those of their parts are kept for the life of a Python worker."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        suffix = self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.closes[number] = token.endswith(suffix)
        separator = self._whole(_SEPARATOR)
        self.separator = separator[0] if len(separator) == 1 else None
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _keep(self, parts: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int = 0) -> None:
        raw, begin = ids.tobytes(), 0
        for part, end in zip(parts, (4 * ends).tolist()):
            self.known[part] = raw[begin:end]
            begin = end + 4 * gap

    def _learn(self, parts: list[bytes]) -> None:
        """Keep the ids of pre-tokens: each has one id that closes a word."""
        ids = self._whole(b" ".join(parts).decode())
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(parts):
            self._keep(parts, ids, ends)
        else:
            self._learn_odd(parts)

    def _learn_odd(self, words: list[bytes]) -> None:
        """Keep the ids of any words: a separator stands between them, unless one of them has its id."""
        if len(words) == 1:
            self.known[words[0]] = self._whole(words[0].decode(errors="replace")).tobytes()
            return
        if self.separator is not None:
            ids = self._whole(f" {_SEPARATOR} ".join([w.decode(errors="replace") for w in words]))
            ends = np.append(np.flatnonzero(ids == self.separator), len(ids))
            if len(ends) == len(words):
                self._keep(words, ids, ends, gap=1)
                return
        self._learn_odd(words[: len(words) // 2])
        self._learn_odd(words[len(words) // 2 :])

    def _pieces(self, vocabulary: list[bytes], odd: np.ndarray) -> list[bytes]:
        """Ids of each part of ``vocabulary``."""
        if len(self.known) > _CACHE_PARTS:
            self.known.clear()
        pieces = list(map(self.known.get, vocabulary))
        for learn, which in ((self._learn, False), (self._learn_odd, True)):
            new = [k for k, p in enumerate(pieces) if p is None and odd[k] == which] if which is False or odd.any() else []
            for k in range(0, len(new), 4096):
                learn([vocabulary[j] for j in new[k : k + 4096]])
            for k in new:
                pieces[k] = self.known[vocabulary[k]]
        return pieces

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with their end ids, and where each text's ids begin (and the last one's end)."""
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        data, starts, at, is_odd = cut_parts(raw)
        offsets = np.append(starts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pc.dictionary_encode(parts)
        codes = np.asarray(coded.indices)
        odd = np.zeros(len(coded.dictionary), dtype=bool)
        odd[codes[is_odd]] = True
        pieces = self._pieces(coded.dictionary.to_pylist(), odd)
        number = np.int32 if len(raw) < 1 << 29 else np.int64  # of ids, of which a byte gives one at most
        sizes = np.fromiter(map(len, pieces), dtype=number, count=len(pieces)) // 4
        pool, begin = np.frombuffer(b"".join(pieces), dtype="<u4"), np.cumsum(sizes, dtype=number) - sizes
        lengths = sizes[codes]
        ends = np.cumsum(lengths, dtype=number)
        places = np.repeat(begin[codes] - (ends - lengths), lengths)
        places += np.arange(len(places), dtype=number)
        ids = pool[places]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        bounds = np.concatenate([[0], ends])[np.searchsorted(at, text_ends)]
        return np.insert(ids, bounds, np.uint32(END_ID)), np.concatenate([[0], bounds + np.arange(1, len(bounds) + 1)])


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _cut(tokenizer_path: str, sequence: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from skerry.llm import _arrow, packing

        work = packing.encoder(tokenizer_path)
        for part, texts in _arrow.text_slices(batches, limit=_SLICE_BYTES):
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            ids, bounds = work.encode(texts)
            bounds = bounds.tolist()
            for doc_id, first, last in zip(part.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                for start in range(first, last, sequence):
                    piece = ids[start : min(start + sequence, last)]
                    rows.append((doc_id, start - first, len(piece), zlib.crc32(piece), last - first))
                    if with_ids:
                        kept.append(piece)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array([p.astype(np.int64) for p in kept], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, *, sequence: int = SEQUENCE, with_ids: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): the pieces that documents are cut into."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(tokenizer_path, sequence, with_ids), PIECES + ", ids array<long>" * with_ids)


def patterns(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) of packs: longest lengths first, each into the shortest open pack.

    An open pack that is shortest has the most space left, so a length fits somewhere only if it
    fits there.  All packs of a pattern take the length at once; a pattern is split when fewer
    pieces than packs are left.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    totals: list[int] = []

    def add(total: int, lengths: tuple[int, ...], count: int) -> None:
        if total not in open_packs:
            open_packs[total] = []
            bisect.insort(totals, total)
        open_packs[total].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not totals or totals[0] + length > sequence:
                add(length, (length,), left)
                break
            total = totals[0]
            lengths, count = open_packs[total].pop()
            if not open_packs[total]:
                del open_packs[total]
                totals.pop(0)
            took = min(left, count)
            add(total + length, (*lengths, length), took)
            if took < count:
                add(total, lengths, count - took)
            left -= took
    return [p for total in totals for p in open_packs[total]]


def pattern_places(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, step, offset): where pieces of a length go by rank.

    Piece ``rank`` of a row lies in sequence ``first sequence + (rank - first rank) % step`` at
    ``offset + length * ((rank - first rank) // step)``: a length that a pattern has several times
    in a row needs only one row.
    """
    used: dict[int, int] = {}
    out, sequence_id = [], 0
    for lengths, count in packs:
        offset, k = 0, 0
        while k < len(lengths):
            n = k
            while n < len(lengths) and lengths[n] == lengths[k]:
                n += 1
            first = used.get(lengths[k], 0)
            last = first + (n - k) * count - 1
            out.append((lengths[k], first, last, sequence_id, count, offset))
            used[lengths[k]] = last + 1
            offset += lengths[k] * (n - k)
            k = n
        sequence_id += count
    return out


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``pieces`` with sequence_id and offset; all other columns stay (names that begin with ``_`` are this function's)."""
    if used := [c for c in pieces.columns if c in ("_row", "_bucket", "_within", "_rank")]:
        raise ValueError(f"columns with names that packing uses: {used}")
    spark = pieces.sparkSession
    place = F.xxhash64("doc_id", "start", "ids_crc32")
    pieces = workspace.materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    buckets = max(8, sum(counts.values()) // PIECES_PER_BUCKET)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    by = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "_bucket").orderBy(place, "_row")
    ranked = pieces.withColumn("_within", F.row_number().over(within) - 1).join(by, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("base") + F.col("_within"))
    table = np.array(pattern_places(patterns(counts, sequence)), dtype=np.int64).reshape(-1, 6)
    ranked = ranked.select(*pieces.drop("_row", "_bucket").columns, "_rank")
    names = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in names] + ["sequence_id long", "offset long"])
    return ranked.mapInArrow(_place(table), schema)


def _place(table: np.ndarray):
    """Look up (length, rank) in the places; their number depends on the sequence length, not on the input."""
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(length) else table[:0]
            nth = rank - row[:, 1]
            out = batch.drop_columns(["_rank"])
            yield out.append_column("sequence_id", pa.array(row[:, 3] + nth % np.maximum(row[:, 4], 1))).append_column("offset", pa.array(row[:, 5] + length * (nth // np.maximum(row[:, 4], 1))))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, sequence: int = SEQUENCE, with_ids: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """Tokenize, cut and pack ``docs``; one row per piece."""
    return pack(token_pieces(docs, tokenizer_path, sequence=sequence, with_ids=with_ids, id_col=id_col, text_col=text_col), sequence)
