"""Source divergence audit: how far each source's terms are from those of the other sources of its language.

Terms are runs of letters a-z (A-Z lower-cased) and bytes from 0x80 on.  A language keeps the terms in at
least ``least_docs`` of its documents.  For a group (lang, source) or a whole language the share of a kept
term is ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``; ``f(p, q) = floor((p - q)^2 / (p + q))`` is the
distance of two shares, in whole numbers throughout.

Plan
----
1. A byte-level tokenizer finds the terms' bounds by a lookup table over concatenated UTF-8 buffers.  Each
   slice of bytes is hashed by XXH64; slices of one hash are compared with the first of them byte by byte,
   and told apart by their bytes where they differ.  A task adds counts up and sends them on beyond
   ``HELD``: (lang, source, term, count, documents).
2. Sums by term give the kept terms, each with its counts by source: a row of a sparse matrix.  They are
   written, and group and language totals are sums over them.
3. Rows are dealt to blocks of about ``BLOCK_ENTRIES`` counts of a language.  A block is a CSR matrix
   (and, by source, its transpose) with the totals of the language's groups; sums over segments (reduceat)
   give each pair's part of the divergence and each group's best terms.  Parts are added up after that.

Nothing is collected on the driver, and a block has a bounded number of counts; it holds the totals of all
sources of its language (a number each) and returns their pairs, of which the result consists as well.

Defined results: null text, lang and source count as empty; a document without terms still makes its group;
a group of a language without kept terms has the value 0 to each other source; of equal values the smaller
item in UTF-8 comes first; repeated rows are documents of their own, identifiers aren't read; an empty table
gives an empty result; a language with one source has no pairs; further columns are ignored, whatever their
names; texts of any length count as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import workspace
from skerry.llm import _arrow
from skerry.llm._arrow import Words

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 10**9
HELD = 1_500_000  # counts that a task holds, of 24 bytes each beside the terms themselves
BLOCK_ENTRIES = 65_536
#: Rows of a table with a row per language that may be broadcast.
BROADCAST_LANGS = 65_536

# The bytes of terms are letters a-z and all from 0x80 on.
SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = False


#: For slices of 0 to 8 bytes, the part of eight bytes from the start on that is theirs (in little-endian order).
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def grouped(words: Words) -> tuple[np.ndarray, list[bytes]]:
    """For each slice of bytes the number of its term, and the terms: equal numbers for equal bytes only.

    A slice of up to eight bytes is its own key; longer ones are hashed.
    """
    raw, hashed, lengths = words.raw, xxhash.xxh64_intdigest, words.ends - words.starts
    eight = np.ndarray((len(raw),), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    keys = eight[words.starts] & _FIRST_BYTES[np.minimum(lengths, 8)]
    long = np.flatnonzero(lengths > 8)
    keys[long] = np.fromiter((hashed(raw[a:b]) for a, b in zip(words.starts[long].tolist(), words.ends[long].tolist())), dtype=np.uint64, count=len(long))
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    return verified(words, first, of)


def verified(words: Words, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """``of`` with numbers of their own for the slices that differ from the first of theirs."""
    raw, lengths = words.raw, words.ends - words.starts
    terms = [raw[words.starts[k] : words.ends[k]] for k in first]
    model = first[of]
    wrong = lengths != lengths[model]
    same = np.flatnonzero(~wrong & (lengths > 8))
    if len(same):
        n = lengths[same]
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(begin, n)
        odd = words.data[np.repeat(words.starts[same], n) + at] != words.data[np.repeat(words.starts[model[same]], n) + at]
        wrong[same] = np.logical_or.reduceat(odd, begin)
    if wrong.any():
        of, more = of.copy(), {}
        for k in np.flatnonzero(wrong):
            term = raw[words.starts[k] : words.ends[k]]
            if (int(of[k]), term) not in more:
                more[int(of[k]), term] = len(terms)
                terms.append(term)
            of[k] = more[int(of[k]), term]
    return of, terms


_COUNTS = "lang string, source string, term string, n long, docs long"


_TERM_BITS = 40


class _Counts:
    """Counts of a task: (group << _TERM_BITS | term), occurrences, documents."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def group(self, name: tuple[str, str]) -> int:
        return self.groups.setdefault(name, len(self.groups))

    def term(self, term: bytes) -> int:
        return self.terms.setdefault(term, len(self.terms))

    def add(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((key, n, docs))

    def held(self) -> int:
        return max(sum(len(p[0]) for p in self.parts), len(self.terms))

    def combine(self) -> None:
        key, n, docs = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.parts = [(key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))]

    def rows(self, size: int = 65_536) -> Iterator[pa.RecordBatch]:
        key, n, docs = self.parts[0]
        langs, sources = (pa.array(x, pa.string()) for x in zip(*self.groups))
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        for k in range(0, len(key), size):
            group, term = key[k : k + size] >> _TERM_BITS, key[k : k + size] & ((1 << _TERM_BITS) - 1)
            columns = [langs.take(pa.array(group)), sources.take(pa.array(group)), terms.take(pa.array(term)), pa.array(n[k : k + size]), pa.array(docs[k : k + size])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task by (lang, source, term); the empty term counts a group's documents."""
    counts = _Counts()
    for part, texts in _arrow.text_slices(batches):
        words = Words(texts, separators=SEPARATORS)
        group = np.array([counts.group(x) for x in zip(part.column("lang").to_pylist(), part.column("source").to_pylist())], dtype=np.int64)
        present, docs = np.unique(group, return_counts=True)
        counts.add(present << _TERM_BITS | counts.term(b""), np.zeros(len(present), dtype=np.int64), docs)
        of, terms = grouped(words)
        if len(of):
            number = np.array([counts.term(t) for t in terms], dtype=np.int64)
            doc = np.repeat(np.arange(len(texts)), words.counts)
            in_doc, times = np.unique(doc * len(terms) + of, return_counts=True)  # a document's term, once
            counts.add(group[in_doc // len(terms)] << _TERM_BITS | number[in_doc % len(terms)], times, np.ones(len(times), dtype=np.int64))
        if counts.held() > HELD:
            counts.combine()
            if counts.held() > HELD // 2:
                yield from counts.rows()
                counts = _Counts()
    if counts.parts:
        counts.combine()
        yield from counts.rows()


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), by long division in steps of a thousand, which no count overflows."""
    rest, whole = count.astype(np.int64) + 2, np.asarray(total, dtype=np.int64) + 2 * kept
    out = np.zeros(np.broadcast(rest, whole).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        step = rest // whole
        rest, out = rest - step * whole, out * 1000 + step
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_sums(term: np.ndarray, source: np.ndarray, share: np.ndarray, none: np.ndarray, terms: int) -> np.ndarray:
    """Sums of distances over ``terms`` terms for all pairs of sources.

    (term, source, share) are the counts above zero, ``none`` is each source's share of a term that it
    lacks.  For one source, the other's entries are visited by source; where the other has none, only the
    source's own entries differ from the distance of two absent terms.
    """
    size = len(none)
    order = np.lexsort((term, source))
    term, source, share = term[order], source[order], share[order]
    ends = np.searchsorted(source, np.arange(size + 1))
    filled = np.flatnonzero(np.diff(ends))
    out = np.zeros((size, size), dtype=np.int64)
    for a in range(size):
        mine = slice(ends[a], ends[a + 1])
        column = np.full(terms, none[a], dtype=np.int64)
        column[term[mine]] = share[mine]
        row = (terms - (ends[a + 1] - ends[a])) * distance(none[a], none)
        for b in range(0, size, 64):  # own entries against the others' absent terms
            row[b : b + 64] += distance(share[mine][:, None], none[None, b : b + 64]).sum(0)
        if len(filled):
            x = column[term]
            row[filled] += np.add.reduceat(distance(x, share) - distance(x, none[source]), ends[filled])
        out[a] = row
    return out


def best_terms(term: np.ndarray, source: np.ndarray, share: np.ndarray, whole: np.ndarray, names: list[str], most: int) -> list[tuple[int, str, int]]:
    """(source, term, distance to the language) of the ``most`` terms of each source that it has more of than the language."""
    over = np.flatnonzero(share > whole[term])
    value = distance(share[over], whole[term[over]])
    rank = np.argsort(np.argsort(np.array([n.encode() for n in names], dtype=object), kind="stable"), kind="stable")
    order = np.lexsort((rank[term[over]], -value, source[over]))
    over, value = over[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], source[over][1:] != source[over][:-1]])) if len(over) else np.zeros(0, int)
    place = np.arange(len(over)) - np.repeat(first, np.diff(np.append(first, len(over))))
    return [(int(source[over[k]]), names[term[over[k]]], int(value[k])) for k in np.flatnonzero(place < most)]


_PARTS = "lang string, source string, part string, item string, value long"


def _block(most: int):
    def work(table: pa.Table) -> pa.Table:
        """One block: rows without a term are the totals of the language's sources, the others its terms."""
        lang = table.column("lang")[0].as_py()
        totals = table.filter(pa.compute.is_null(table.column("term"))).sort_by("source")
        rows = table.filter(pa.compute.is_valid(table.column("term")))
        names = totals.column("source").to_pylist()
        place = {s: k for k, s in enumerate(names)}
        total, kept, whole_total = np.asarray(totals.column("total")), int(totals.column("kept")[0].as_py()), int(totals.column("lang_total")[0].as_py())
        out: list[tuple] = []
        sums = np.zeros((len(names), len(names)), dtype=np.int64)
        if kept and rows.num_rows:
            counts = rows.column("counts").combine_chunks()
            lengths = np.diff(np.asarray(counts.offsets))
            term = np.repeat(np.arange(rows.num_rows), lengths)
            flat = counts.flatten()
            source = np.array([place[s] for s in flat.field("source").to_pylist()], dtype=np.int64)
            n = np.asarray(flat.field("n")).astype(np.int64)
            share = shares(n, total[source], kept)
            sums = pair_sums(term, source, share, shares(np.zeros(len(names), dtype=np.int64), total, kept), rows.num_rows)
            whole = shares(np.add.reduceat(n, np.asarray(counts.offsets)[:-1] - counts.offsets[0].as_py()), np.int64(whole_total), kept)
            out += [(lang, names[s], "term", t, v) for s, t, v in best_terms(term, source, share, whole, rows.column("term").to_pylist(), most)]
        out += [(lang, names[a], "pair", names[b], int(sums[a, b])) for a in range(len(names)) for b in range(len(names)) if a != b]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()])], names=["lang", "source", "part", "item", "value"])

    return work


def audit(docs: DataFrame, *, text_col="text", lang_col="lang", source_col="source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank; ranks count from 1 in each group and part."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    # Tasks have added up what they could; dealt by term, both sums need one shuffle.
    counted = docs.select(*named).mapInArrow(_count, _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = workspace.materialize(by_term.filter((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "counts"), "audit-terms")
    groups = kept.filter("term = ''").select("lang", F.explode("counts.source").alias("source"))
    kept = kept.filter("term <> ''")
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"), F.count(F.lit(1)).alias("entries"))
    groups = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("entries", F.lit(0)).alias("entries"))
    groups = workspace.materialize(groups, "audit-groups")
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    blocks = F.greatest(F.ceil(F.sum("entries") / block_entries), F.lit(1)).cast("long").alias("blocks")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), blocks).join(terms, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    langs = workspace.materialize(langs, "audit-langs")
    known = F.broadcast(langs) if langs.count() <= BROADCAST_LANGS else langs
    none = [F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("counts", "array<struct<source:string,n:bigint>>"))]
    totals = groups.join(known, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "kept", "lang_total", *none)
    rows = kept.join(known.select("lang", "blocks"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("total", "long"), ("kept", "long"), ("lang_total", "long"))], "term", "counts",
    )
    parts = totals.unionByName(rows).groupBy("lang", "block").applyInArrow(_block(top_terms), _PARTS)
    parts = workspace.materialize(parts, "audit-parts")
    value = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block only
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return value.withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= top_terms)).select("lang", "source", "part", "item", "value", "rank")
