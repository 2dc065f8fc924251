"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the bytes of whole texts, vectorised over the texts of an Arrow slice.
The trees are fitted on the driver from a bounded sample of labelled rows (``sample_rows``, a
parameter) and flattened into arrays, so a batch descends all trees by array indexing.

Defined results: a null text counts as empty and is scored like an empty one; repeated rows get
equal scores; labels that are null or belong to no document are not used, of several labels of a
document each counts; without labels every score is 0.5; an empty table gives an empty result;
further columns are ignored (:func:`keep_good` keeps them); texts of any length are scored as a whole; ties
of labels' hashes don't arise, since rows are chosen by a threshold on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm import _arrow
from skerry.llm._arrow import Words, segment_sums

#: At most about so many labelled rows are gathered for fitting.
SAMPLE_ROWS = 40_000
THRESHOLD = 0.3

# The statistics, in the order of the feature matrix.
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "blank", "newlines", "letters_end_stop", "commas",
    "exclaims", "pipes", "symbols", "non_ascii", "words_upper", "words_odd_end", "words_exclaim_end", "words_single",
    "words_pipe", "words_long", "worst_upper", "worst_odd_end", "worst_exclaim", "worst_pipe", "repeat_words", "repeat_lines", "short_lines",
)
_ODD = np.zeros(256, dtype=bool)
_ODD[[*b"#$%&*+<=>@\\^_`{}~"]] = True
_STRETCH = 32
#: Some ten numbers of eight bytes for each byte of a slice are in memory at once.
STATISTICS_BYTES = 1 << 20


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(keys: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Per text, the number of keys that an earlier one of the same text equals."""
    if not len(keys):
        return np.zeros(texts)
    order = np.lexsort((keys, text))
    same = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][1:][same], minlength=texts).astype(float)


def _span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each byte span, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    table = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64)
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    step = np.full(len(data), base, dtype=np.uint64)
    step[:1] = 1
    power = np.cumprod(step)
    back = np.full(len(data), inverse, dtype=np.uint64)
    back[:1] = 1
    back = np.cumprod(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * power)])
    key = (total[ends] - total[starts]) * back[starts]
    key ^= key >> np.uint64(32)
    return key * np.uint64(0xD6E8FEB86659FD93) ^ (ends - starts).astype(np.uint64)


def statistics(texts: list[bytes]) -> np.ndarray:
    """(texts, FEATURES) matrix of whole texts."""
    words = Words(texts, lower=False)
    data, n = words.data, len(texts)
    size = np.array([len(t) for t in texts], dtype=float)
    bounds = words.text_starts

    def count(mask: np.ndarray) -> np.ndarray:
        return segment_sums(mask.astype(np.int32), bounds).astype(float)

    upper = (data >= 65) & (data <= 90)
    starts, ends, per = words.starts, words.ends, words.counts.astype(float)
    text_of = np.repeat(np.arange(n), words.counts)
    length = ends - starts
    last = data[np.maximum(ends - 1, 0)] if len(ends) else data[:0]
    uppers = np.concatenate([[0], np.cumsum(upper)])
    lowers = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    word_upper = (uppers[ends] - uppers[starts] > 0) & (lowers[ends] == lowers[starts])
    odd_end, exclaim, pipe = _ODD[last], last == 33, (last == 124) & (length == 1)
    single = (length == 1) & ~pipe

    def words_with(mask: np.ndarray) -> np.ndarray:
        return segment_sums(mask.astype(np.int32), words.bounds).astype(float)

    # The worst stretch: words in runs of _STRETCH within a text.
    position = np.arange(len(starts)) - np.repeat(words.bounds[:-1], words.counts)
    stretches = (words.counts + _STRETCH - 1) // _STRETCH
    stretch = position // _STRETCH + np.repeat(np.cumsum(stretches) - stretches, words.counts)
    total = int(stretches.sum())
    owner = np.repeat(np.arange(n), stretches)
    held = np.maximum(np.bincount(stretch, minlength=total), 8)

    def worst(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, owner, np.bincount(stretch, weights=mask, minlength=total) / held)
        return out

    newline = data == 10
    line_ends = np.flatnonzero(newline)  # each text ends with one
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    line_text = np.searchsorted(bounds, line_starts, side="right") - 1
    lines = np.bincount(line_text, minlength=n).astype(float)
    filled = line_ends > line_starts
    keys = _span_keys(data, np.concatenate([starts, line_starts[filled]]), np.concatenate([ends, line_ends[filled]]))
    stops = np.isin(last, np.frombuffer(b".!?", dtype=np.uint8))
    columns = [
        np.log1p(size), np.log1p(per), _ratio(size, per), _ratio(count(upper), size), _ratio(count((data >= 48) & (data <= 57)), size),
        _ratio(count((data == 32) | newline), size), _ratio(lines, per), _ratio(words_with(stops), per), _ratio(count(data == 44), size),
        _ratio(count(data == 33), size), _ratio(count(data == 124), size), _ratio(count(_ODD[data]), size), _ratio(count(data >= 128), size),
        _ratio(words_with(word_upper & (length > 1)), per), _ratio(words_with(odd_end), per), _ratio(words_with(exclaim), per), _ratio(words_with(single), per),
        _ratio(words_with(pipe), per), _ratio(words_with(length > 20), per),
        worst(word_upper & (length > 1)), worst(odd_end), worst(exclaim), worst(pipe),
        _ratio(_repeats(keys[: len(starts)], text_of, n), per), _ratio(_repeats(keys[len(starts) :], line_text[filled], n), lines),
        _ratio(np.bincount(line_text, weights=(line_ends - line_starts) < 20, minlength=n), lines),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); greater goes right
    value: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
            inner = self.feature.shape[1]
            row = np.arange(len(x))[:, None]
            while node.size and node[0, 0] < inner:
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            raw += self.value[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 5.0) -> Trees:
    """Boost logistic loss; each level's splits come from gradient and hessian histograms of binned features."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x > edge[k]: bin > k
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    raw = np.full(len(y), base)
    out = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * bins + binned[:, j]
                g = np.bincount(cell, grad, width * bins).reshape(width, bins)
                h = np.bincount(cell, hess, width * bins).reshape(width, bins)
                gl, hl = g.cumsum(1)[:, : len(e)], h.cumsum(1)[:, : len(e)]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < least) | (ht - hl < least)] = 0
                k = gain.argmax(1)
                found = gain[np.arange(width), k]
                better = found > best
                best[better] = found[better]
                out.feature[t, first : first + width][better] = j
                out.threshold[t, first : first + width][better] = e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.threshold[t, node])
        leaf = node - inner
        value = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + penalty)
        out.value[t] = value
        raw += value[leaf]
    return out


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _arrow.text_slices(batches, limit=STATISTICS_BYTES):
        x = statistics(texts)
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> Trees:
    """Fit on at most about ``sample_rows`` labelled rows, chosen by a hash of their identifiers."""
    known = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).dropna()
    rows = known.count()
    if rows > sample_rows:
        share = int(sample_rows / rows * 2**31)
        known = known.filter(F.pmod(F.xxhash64(F.lit(seed), "label_id"), F.lit(2**31)) < share)
    known = known.limit(2 * sample_rows)  # the bound of the broadcast; the filter leaves about half of it
    picked = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "label_id")
    table = picked.select("label", "text").mapInArrow(_statistics_of, "label int, x array<double>").toArrow()
    x = np.array(table.column("x").to_pylist(), dtype=float).reshape(table.num_rows, len(FEATURES))
    y = np.asarray(table.column("label").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))  # rows come in any order; sums of floats shall not
    return fit(x[order], y[order])


def _scorer(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _arrow.text_slices(batches, limit=STATISTICS_BYTES):
            yield part.drop_columns(["text"]).append_column("score", pa.array(trees.score(statistics(texts))))

    return run


def score(docs: DataFrame, trees: Trees, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, score: one row per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(trees), "doc_id long, score double")


def keep_good(docs: DataFrame, trees: Trees, *, text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _arrow.text_slices(batches, text_col, STATISTICS_BYTES):
            yield part.filter(pa.array(trees.score(statistics(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema).select(*names)


def in_fold(doc_id: Column, fold: int, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod ``folds`` is ``fold``; a null identifier is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
