"""Brown class-based n-gram scoring.

Model: P(word | previous word) = P(class | class of the previous word) * P(word | class), over the
words of a text and one end token; the text's start stands in the end token's class.

Classes come about in two steps.  First, exchange clustering moves *units* between classes: the
``own_units`` most frequent words, the end token, and a unit for each spelling (a hash of the last two
bytes).  Its table of unit pairs is bounded by the units.  Then every other word of the training texts,
however rare, is exchanged by itself: its contexts (counts of the classes before and after it under the
first step) are a table that grows with the vocabulary, and it goes where the likelihood gains most
while all else is held.  Transitions are counted again under the classes that result.  The spelling's
class remains that of words without any occurrence in the training texts.

Counts and classes of words are exact and complete: a table in the shared folder.  The words above a
count threshold (at most ``head_words``, which bounds the broadcast) are resolved in the map stage; every
token of the rest is joined to the table by a 64-bit key, and meets its neighbours again by row and place.
While words are counted a second key of each is compared wherever first keys are equal; if two words share a
key, all are counted anew under other keys.  So training words are one only if 128 bits of two hashes agree;
a word without any training occurrence has the count of another only if 64 bits do.

Smoothing: emissions add 0.5 to each count and to one unseen word per class; transitions are
interpolated with the class shares.

Defined results: a null text counts as empty and has one token, the end; repeated rows are scored
separately; a null identifier is in the training part; without training texts all counts are 0;
an empty table gives an empty result; further columns are ignored; texts of any length are scored as a
whole; of classes that gain equally the lowest number counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry import workspace
from skerry.llm import _arrow
from skerry.llm._arrow import Words, segment_sums

OWN_UNITS = 1_000
SPELLINGS = 512
CLASSES = 48
MOST_CLASSES = 127  # a context and a class are packed into eight bits each
SWEEPS = 8
HEAD_WORDS = 131_072
#: A worker gathers contexts of texts of so many bytes at a time, and sends them on beyond so many rows.
CONTEXT_BYTES = 1 << 20
CONTEXTS_HELD = 300_000
ADD = 0.5

#: Words of more bytes are hashed by XXH64: a polynomial modulo 2**64 can't tell apart some pairs of words from 1,024 letters on.
LONG_WORD = 64
#: Keys of words are tried with so many tables, until no two training words share one.
TRIES = 8
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


@lru_cache(2 * TRIES)
def _table(salt: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(2024 + salt)).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, _arrow.SLICE_BYTES + 65_536)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step)
    return _POWERS["up"], _POWERS["down"]


def word_keys(words: Words, salt: int = 0) -> np.ndarray:
    """A 64-bit key for each word, as a signed number."""
    n = len(words.data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_table(salt)[words.data] * up[:n], out=total[1:])
    key = (total[words.ends] - total[words.starts]) * down[words.starts]
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    lengths = words.ends - words.starts
    key += lengths.astype(np.uint64)
    long = np.flatnonzero(lengths > LONG_WORD)
    if len(long):
        key[long] = [xxhash.xxh64_intdigest(words.raw[words.starts[k] : words.ends[k]], salt) for k in long]
    return key.view(np.int64)


def spellings(words: Words) -> np.ndarray:
    """The spelling of each word: a number below SPELLINGS from its last two bytes."""
    last = words.data[words.ends - 1].astype(np.int64)
    before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.int64)
    return ((last * 257 + before) * 40503 >> 7) % SPELLINGS


def _count_words(salt: int):
    """key, proof, spelling, n: partial counts of a partition, combined as far as memory allows.

    ``proof`` is a second key, by another table: words are one where both are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def one_each(key, proof, spell, n) -> tuple:
            order = np.lexsort((proof, key))
            key, proof = key[order], proof[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (proof[1:] != proof[:-1])])) if len(key) else order
            return key[first], proof[first], spell[order][first], np.add.reduceat(n[order], first) if len(first) else n

        def combined() -> tuple:
            return one_each(*(np.concatenate(x) for x in zip(*parts)))

        def batch(part: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["key", "proof", "spelling", "n"])

        for _, texts in _arrow.text_slices(batches):
            words = Words(texts)
            keys = word_keys(words, salt)
            uniq, first, of, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            proof = word_keys(words, salt + TRIES)
            if (proof != proof[first][of]).any():
                parts.append(one_each(keys, proof, spellings(words), np.ones(len(keys), dtype=np.int64)))
            else:
                parts.append((uniq, proof[first], spellings(words)[first] if len(first) else first, n))
            held += len(parts[-1][0])
            if held > 1_500_000:
                parts = [combined()]
                held = len(parts[0][0])
                if held > 1_000_000:
                    yield batch(parts[0])
                    parts, held = [], 0
        if parts:
            yield batch(combined())

    return run


@dataclass
class Units:
    """Which unit a word belongs to."""

    keys: np.ndarray  # sorted keys of the words with units of their own
    ids: np.ndarray
    salt: int = 0  # of all keys

    @property
    def end(self) -> int:
        return len(self.keys) + SPELLINGS

    @property
    def size(self) -> int:
        return self.end + 1

    def of(self, keys: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        out = len(self.keys) + spelling
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            own = self.keys[at] == keys
            out = np.where(own, self.ids[at], out)
        return out


def _token_units(words: Words, units: Units, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, previous unit) of every token: the words of each text, then its end."""
    n = len(words.counts)
    out = np.full(len(keys) + n, units.end, dtype=np.int64)
    at = np.arange(len(keys)) + np.repeat(np.arange(n), words.counts)
    out[at] = units.of(keys, spellings(words))
    before = np.concatenate([[units.end], out[:-1]]) if len(out) else out
    return out, before


def _count_pairs(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units.size**2, dtype=np.int64)
        for _, texts in _arrow.text_slices(batches):
            words = Words(texts)
            now, before = _token_units(words, units, word_keys(words, units.salt))
            pair, n = np.unique(before * units.size + now, return_counts=True)
            total[pair] += n
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the units from their pair counts: each unit in turn goes where likelihood gains most."""
    size = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    label = np.empty(size, dtype=np.int64)
    label[order] = np.arange(size) % classes
    pairs = pairs.astype(float)
    member = np.zeros((size, classes))
    member[np.arange(size), label] = 1
    table = member.T @ pairs @ member
    right, left = pairs @ member, (member.T @ pairs).T  # unit -> class after it, class before it
    index = np.arange(classes)
    for _ in range(sweeps):
        moves = 0
        for w in order:
            if not weight[w]:
                continue
            own, me = pairs[w, w], label[w]
            after, before = right[w].copy(), left[w].copy()
            after[me] -= own
            before[me] -= own
            table[me, :] -= after
            table[:, me] -= before
            table[me, me] -= own
            # Gain in sum of n log n over cells, less that over row and column sums.
            rows, columns = table.sum(1), table.sum(0)
            out_n, in_n = after.sum() + own, before.sum() + own
            gain = (_xlogx(table + after[None, :]) - _xlogx(table)).sum(1) + (_xlogx(table + before[:, None]) - _xlogx(table)).sum(0)
            corner = table[index, index]
            gain += _xlogx(corner + after + before + own) - _xlogx(corner + after) - _xlogx(corner + before) + _xlogx(corner)
            gain -= _xlogx(rows + out_n) - _xlogx(rows) + _xlogx(columns + in_n) - _xlogx(columns)
            to = int(gain.argmax())
            if gain[to] <= gain[me] + 1e-9:
                to = me
            table[to, :] += after
            table[:, to] += before
            table[to, to] += own
            if to != me:
                label[w] = to
                moves += 1
                right[:, me] -= pairs[:, w]
                right[:, to] += pairs[:, w]
                left[:, me] -= pairs[w, :]
                left[:, to] += pairs[w, :]
        if not moves:
            break
    return label


def _count_contexts(units: Units, label: np.ndarray, classes: int):
    """key, cell: a word without a unit of its own, and a context of it with its count, in one number.

    The context is the class before the word (from 0), the class after it (from ``classes``), or the
    word itself before it (2 ``classes``).  See :func:`_cells`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def combined() -> tuple:
            key, place, n = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            return _merged(key, place, n)

        def batch(part: tuple) -> pa.RecordBatch:
            key, place, n = part
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64) << 16 | place)], names=["key", "cell"])

        for _, texts in _arrow.text_slices(batches, limit=CONTEXT_BYTES):
            words = Words(texts)
            keys = word_keys(words, units.salt)
            now, _ = _token_units(words, units, keys)
            at = np.arange(len(keys)) + np.repeat(np.arange(len(texts)), words.counts)
            same = np.zeros(len(now) + 1, dtype=bool)  # a token that repeats the one before
            same[at[1:]] = (keys[1:] == keys[:-1]) & (np.diff(at) == 1)
            unit = label[now]
            mine = now[at] >= len(units.keys)
            at, keys = at[mine], keys[mine]
            before = np.where(same[at], 2 * classes, np.where(at > 0, unit[np.maximum(at - 1, 0)], label[units.end]))
            other = ~same[at + 1]
            place = np.concatenate([before, (classes + unit[at + 1])[other]]) << 8 | np.concatenate([unit[at], unit[at][other]])
            parts.append((np.concatenate([keys, keys[other]]), place.astype(np.uint16), np.ones(len(place), np.int32)))
            held += len(place)
            if held > CONTEXTS_HELD:
                parts[:] = [combined()]
                held = len(parts[0][0])
                if held > CONTEXTS_HELD // 2:
                    yield batch(parts.pop())
                    held = 0
        if parts:
            yield batch(combined())

    return run


def _merged(key: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (key, place) as one, with the sum of their counts, in order."""
    order = np.lexsort((place, key))
    key, place, n = key[order], place[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])) if len(key) else np.zeros(0, np.int64)
    return key[first], place[first], np.add.reduceat(n, first) if len(first) else n


def _cells(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, class of the word so far, count)."""
    return cell >> 8 & 255, cell & 255, cell >> 16


def best_classes(table: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, me: np.ndarray) -> np.ndarray:
    """Where each word by itself goes by exchange, all others held; the arguments are as in :func:`exchange`, a row per word."""
    n, classes = after.shape
    every = np.arange(n)
    rows, columns = np.tile(table.sum(1), (n, 1)), np.tile(table.sum(0), (n, 1))  # of the rest, and of pairs whose other half is the word
    rows[every, me] -= after.sum(1) + own
    columns[every, me] -= before.sum(1) + own
    out_n, in_n = (after.sum(1) + own)[:, None], (before.sum(1) + own)[:, None]
    gain = -(_xlogx(rows + out_n) - _xlogx(rows) + _xlogx(columns + in_n) - _xlogx(columns))
    corner = np.tile(np.diag(table), (n, 1))
    corner[every, me] -= after[every, me] + before[every, me] + own
    gain += _xlogx(corner + after + before + own[:, None]) - _xlogx(corner + after) - _xlogx(corner + before) + _xlogx(corner)
    for here, there, cells in ((after, before, table.T), (before, after, table)):
        w, c = np.nonzero(here)
        times = here[w, c]
        cell = cells[c].copy()
        cell[np.arange(len(w)), me[w]] -= times
        inside = np.flatnonzero(me[w] == c)
        cell[inside] -= there[w[inside]]
        cell[inside, c[inside]] -= own[w[inside]]
        gained = _xlogx(cell + times[:, None]) - _xlogx(cell)
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
        if len(w):
            gain[w[first]] += np.add.reduceat(gained, first, axis=0)
    to = gain.argmax(1)
    return np.where(gain[every, to] > gain[every, me] + 1e-9, to, me)


def _assign(table: np.ndarray):
    """key, n, class of the words whose contexts come in order of their keys."""
    classes = len(table)

    def settled(key: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        context, me, n = _cells(cell)
        uniq, first, w = np.unique(key, return_index=True, return_inverse=True)
        wide = np.bincount(w * (2 * classes + 1) + context, weights=n, minlength=len(uniq) * (2 * classes + 1)).reshape(len(uniq), -1)
        before, after, own = wide[:, :classes], wide[:, classes : 2 * classes], wide[:, -1]
        to = best_classes(table, after, before, own, me[first])
        return pa.RecordBatch.from_arrays([pa.array(uniq), pa.array((before.sum(1) + own).astype(np.int64)), pa.array(to.astype(np.int32))], names=["key", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            key, cell = (np.concatenate([held[k], np.asarray(batch.column(k))]) for k in range(2))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last word may go on
            if cut:
                yield settled(key[:cut], cell[:cut])
            held = (key[cut:], cell[cut:])
            if len(held[0]) > CONTEXTS_HELD:  # a word that very many tasks have met
                key, place, n = _merged(held[0], held[1] & 0xFFFF, held[1] >> 16)
                held = (key, n << 16 | place)
        if len(held[0]):
            yield settled(*held)

    return run


@dataclass
class Model:
    units: Units
    label: np.ndarray  # class of each unit
    transition: np.ndarray | None  # log10 P(class | previous class)
    room: np.ndarray | None  # log10 of the emission's denominator of each class
    head_keys: np.ndarray
    head_log: np.ndarray  # log10(count + ADD)
    head_class: np.ndarray
    end_log: float
    tokens: int
    distinct: int
    counts: DataFrame | None = None  # key, n, class of every word of the training texts


def _shared(spark: SparkSession, model: Model):
    counts, model.counts = model.counts, None
    shared = spark.sparkContext.broadcast(model)  # HEAD_WORDS keys, logarithms and classes, some 3 MB
    shared.value  # noqa: B018
    model.counts = counts
    return shared


def _known_classes(words: Words, model: Model, keys: np.ndarray):
    """For the words: whether in the head, place in the head, place among tokens; for the tokens: class, -1 outside the head."""
    head = model.head_keys
    at = np.minimum(np.searchsorted(head, keys), max(len(head) - 1, 0))
    known = head[at] == keys if len(head) else np.zeros(len(keys), bool)
    n = len(words.counts)
    place = np.arange(len(keys)) + np.repeat(np.arange(n), words.counts)
    now = np.full(len(keys) + n, model.label[model.units.end], dtype=np.int64)
    now[place] = np.where(known, model.head_class[at], -1) if len(head) else -1
    return known, at, place, now


def _tail(words: Words, model: Model, keys, known, place, now, before) -> pa.Array:
    """Per text its words outside the head: place, key, the classes around them (-1 outside the head), the class of their spelling."""
    where = place[~known]
    other = model.label[len(model.units.keys) + spellings(words)[~known]]
    ends = np.concatenate([[0], np.cumsum(~known)])[words.bounds]
    fields = [where.astype(np.int32), keys[~known], before[where].astype(np.int32), now[where + 1].astype(np.int32), other.astype(np.int32)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(f) for f in fields], names=["at", "key", "left", "right", "other"]))


_TAIL = "tail array<struct<at:int,key:long,left:int,right:int,other:int>>"


def _count_transitions(shared, classes: int):
    """Pairs of classes within the head, and the words outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total = np.zeros(classes**2, dtype=np.int64)
        for part, texts in _arrow.text_slices(batches):
            words = Words(texts)
            keys = word_keys(words, model.units.salt)
            known, _, place, now = _known_classes(words, model, keys)
            before = np.concatenate([[model.label[model.units.end]], now[:-1]])
            both = (now >= 0) & (before >= 0)
            total += np.bincount(before[both] * classes + now[both], minlength=classes**2)
            none = pa.array([[]] * len(texts), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("row"), _tail(words, model, keys, known, place, now, before), none], names=["row", "tail", "pairs"])
        last = pa.array([[]], pa.list_(pa.struct([(f, pa.int64() if f == "key" else pa.int32()) for f in ("at", "key", "left", "right", "other")])))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), last, pa.array([total.tolist()], pa.list_(pa.int64()))], names=["row", "tail", "pairs"])

    return run


def _resolved(part: DataFrame, counts: DataFrame) -> DataFrame:
    """row, left, right, n, class of each token outside the head; ``left`` is the class before it also where that is another such token's."""
    tail = part.select("row", F.inline("tail")).join(counts.select("key", "n", "class"), "key", "left")
    tail = tail.withColumn("class", F.coalesce("class", "other"))
    before = F.lag("class").over(Window.partitionBy("row").orderBy("at"))
    return tail.select("row", F.when(F.col("left") >= 0, F.col("left")).otherwise(before).alias("left"), "right", "n", "class")


def _counted(texts: DataFrame) -> tuple[DataFrame, int]:
    """(key, spelling, n of every word, the salt of the keys): keys under which no two words meet."""
    for salt in range(TRIES):
        counted = texts.mapInArrow(_count_words(salt), "key long, proof long, spelling long, n long")
        sums = [F.first("spelling").alias("spelling"), F.sum("n").alias("n"), (F.min("proof") != F.max("proof")).alias("shared")]
        counts = workspace.materialize(counted.groupBy("key").agg(*sums), "brown-counts")
        if counts.filter("shared").isEmpty():
            return counts.drop("shared"), salt
        workspace.release(counts)
    raise ValueError(f"words share keys in {TRIES} tables")


def train(docs: DataFrame, *, id_col="doc_id", text_col="text", classes: int = CLASSES, own_units: int = OWN_UNITS, head_words: int = HEAD_WORDS) -> Model:
    """Learn the model from all rows of ``docs``."""
    if not 1 <= classes <= MOST_CLASSES:
        raise ValueError(f"there can be 1 to {MOST_CLASSES} classes")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    counts, salt = _counted(texts)
    n_docs = docs.count()
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    head = _head(counts, head_words, "spelling")
    own = head[np.lexsort((head[:, 0], -head[:, 2]))][:own_units]
    own = own[np.argsort(own[:, 0])]
    units = Units(own[:, 0], np.arange(len(own)), salt)
    pairs = np.zeros(units.size**2, dtype=np.int64)
    found = texts.mapInArrow(_count_pairs(units), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # units**2 rows at most
    pairs[np.asarray(found.column("pair"))] = np.asarray(found.column("n"))
    pairs = pairs.reshape(units.size, units.size)
    label = exchange(pairs, classes)
    member = np.zeros((units.size, classes))
    member[np.arange(units.size), label] = 1
    contexts = texts.mapInArrow(_count_contexts(units, label, classes), "key long, cell long")
    alone = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_assign(member.T @ pairs @ member), "key long, n long, class int")
    fixed = spark.createDataFrame([(int(k), int(n), int(c)) for (k, _, n), c in zip(own, label)], "key long, n long, class int")  # OWN_UNITS rows
    words = workspace.materialize(alone.unionByName(fixed), "brown-words")
    workspace.release(counts)
    head = _head(words, head_words, "class")
    head = head[np.argsort(head[:, 0])]
    model = Model(
        units, label, None, None, head[:, 0], np.log10(head[:, 2] + ADD), head[:, 1], float(np.log10(n_docs + ADD)),
        int(total["n"]) + n_docs, int(total["v"]) + (1 if n_docs else 0), words,
    )
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    part = workspace.materialize(rows.mapInArrow(_count_transitions(_shared(spark, model), classes), f"row long, {_TAIL}, pairs array<long>"), "brown-train")
    table = np.zeros(classes**2)
    known = part.filter("row < 0").select(F.posexplode("pairs").alias("pair", "n"))
    rest = _resolved(part.filter("row >= 0"), words)
    rest = rest.select(F.explode(F.array(F.col("left") * classes + F.col("class"), F.when(F.col("right") >= 0, F.col("class") * classes + F.col("right")))).alias("pair"))
    rest = rest.filter("pair is not null").select("pair", F.lit(1).cast("long").alias("n"))
    for r in known.unionByName(rest).groupBy("pair").agg(F.sum("n").alias("n")).collect():  # classes**2 rows at most
        table[r["pair"]] = r["n"]
    workspace.release(part)
    table = table.reshape(classes, classes)
    in_class = table.sum(0)
    share = (in_class + 1) / (in_class.sum() + classes)
    model.transition = np.log10((table + share[None, :]) / (table.sum(1, keepdims=True) + 1))
    distinct = np.zeros(classes)
    for r in words.groupBy("class").agg(F.count(F.lit(1)).alias("v")).collect():  # one row per class
        distinct[r["class"]] = r["v"]
    distinct[label[units.end]] += 1 if n_docs else 0
    model.room = np.log10(in_class + ADD * (distinct + 1))
    return model


def _head(counts: DataFrame, most: int, what: str) -> np.ndarray:
    """(key, ``what``, n) of all words above the least count that leaves at most ``most`` words."""
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect()
    taken, least = 0, None
    for row in levels:
        if taken + row["words"] > most:
            break
        taken, least = taken + row["words"], row["n"]
    if least is None:
        return np.zeros((0, 3), dtype=np.int64)
    table = counts.filter(F.col("n") >= least).select("key", what, "n").toArrow()
    return np.stack([np.asarray(table.column(c)) for c in ("key", what, "n")], axis=1)


_PARTIAL = f"row long, doc_id long, n_tokens long, n_head long, head_log double, class_log double, {_TAIL}"


def _score_part(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        classes = len(model.room)
        flat = model.transition.ravel()
        for part, texts in _arrow.text_slices(batches):
            words = Words(texts)
            keys = word_keys(words, model.units.salt)
            n = len(texts)
            known, at, place, now = _known_classes(words, model, keys)
            before = np.concatenate([[model.label[model.units.end]], now[:-1]])
            ends = words.bounds + np.arange(n + 1)
            class_log = np.where(now >= 0, -model.room[now], 0.0)
            both = (now >= 0) & (before >= 0)
            class_log[both] += flat[before[both] * classes + now[both]]
            logs = np.where(known, model.head_log[at], 0.0) if len(model.head_keys) else np.zeros(len(keys))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(words.counts + 1, pa.int64()), pa.array(segment_sums(known.astype(np.int64), words.bounds)),
                 pa.array(segment_sums(logs, words.bounds) + model.end_log), pa.array(segment_sums(class_log, ends)), _tail(words, model, keys, known, place, now, before)],
                names=["row", "doc_id", "n_tokens", "n_head", "head_log", "class_log", "tail"],
            )

    return run


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row per document."""
    shared = _shared(docs.sparkSession, model)
    classes = len(model.room)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    part = workspace.materialize(rows.mapInArrow(_score_part(shared), _PARTIAL), "brown-part")
    flat, room = F.lit(model.transition.ravel().tolist()), F.lit(model.room.tolist())
    c = F.col("class")
    after = F.when(F.col("right") >= 0, F.get(flat, c * classes + F.col("right"))).otherwise(0.0)
    tail = _resolved(part, model.counts).groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("tail_log"), F.count("n").alias("n_tail"),
        F.sum(F.get(flat, F.col("left") * classes + c) + after - F.get(room, c)).alias("tail_class"),
    )
    words = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    unseen = float(np.log10(model.tokens + ADD * (model.distinct + 1)))
    out = part.drop("tail").join(tail, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(1 if model.tokens else 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (words - F.col("n_tokens") * F.lit(unseen)).alias("base_score"),
        (words + F.col("class_log") + F.coalesce("tail_class", F.lit(0.0))).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
