"""Benchmark decontamination: n-grams of test items in a broadcast set, token windows scanned and verified (native).

Words are runs of letters a-z (A-Z lower-cased), digits and characters from U+0080 on.  A window is ``n``
consecutive words of an item; an item of fewer words is one window.

Plan
----
1. A window of ``n`` words holds, wherever it stands, a run of ``n - stride + 1`` words that starts at a
   multiple of ``stride`` (``stride`` is half of ``n``).  So only those runs of a document are hashed, and
   met with the hashes of all runs of that length in the items' windows: a set of numbers, broadcast
   behind a check of its size and joined in shuffles beyond it.
2. A run that meets carries the few words around it.  Each start of a window that the run can belong to
   is compared there by the words themselves, so a hash that meets by chance finds nothing.
3. What a document's windows cover is counted by distinct places, its items by distinct identifiers:
   aggregations that are partial before the shuffle, with no task for a document or an item.

A text is cut into pieces of ``PIECE`` words before its runs are formed, so a long text is never held
several times over.

Defined results: a null or empty text, or one without words, is clean and has no words; items without words
have no windows; a null item identifier counts as an empty one, rows with equal identifiers are one item; a
null document identifier and repeated rows are rows of their own; equal windows of several items count for
each of them; an empty table of documents gives an empty result, an empty benchmark clean documents;
further columns are ignored by :func:`findings` and kept by :func:`without_documents` and
:func:`without_spans`, whatever their names; texts of any length are scanned as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry import workspace
from skerry.llm._columns import computed_once, unused

N = 10
PIECE = 4_096
#: Hashes of runs that may be broadcast, of some 20 bytes each; windows of some 100 bytes.
BROADCAST_RUNS = 1_000_000
BROADCAST_WINDOWS = 200_000

# What words are made of, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words as they stand, with their capitals."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _stride(n: int) -> int:
    return max(1, n // 2)


def _run(words: Column, start: Column, length: int) -> Column:
    """A hash of ``length`` words from ``start`` on, counted from 0.

    All letters are lower-cased here, which is quicker and lets no two runs differ that are equal by A-Z.
    """
    return F.xxhash64(F.lower(F.array_join(F.slice(words, start + 1, F.lit(length)), " ")))


def windows_of(items: DataFrame, n: int = N, *, item_col="item_id", text_col="text") -> DataFrame:
    """window (words joined by a space), length, items: one row per different window, written."""
    words = computed_once(items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), lowered(F.col(f"`{text_col}`")).alias("text")), words=words_of(F.col("text")))
    length = F.least(F.size("words"), F.lit(n))
    each = words.filter(F.size("words") > 0).select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("first"))
    each = each.select("item", "length", F.array_join(F.slice("words", F.col("first"), F.col("length")), " ").alias("window"))
    return workspace.materialize(each.groupBy("window", "length").agg(F.sort_array(F.collect_set("item")).alias("items")), "benchmark-windows")


def _runs_from(words: Column, starts: Column, size: int) -> Column:
    return F.transform(starts, lambda k: _run(words, k, size))


def _runs(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(length, run) of all windows, each once, and the mark (0, 0) that every document carries."""
    out = windows.sparkSession.range(1).select(F.lit(0).alias("length"), F.lit(0).cast("long").alias("run"))
    for length in lengths:
        size = length - _stride(length) + 1
        words = F.split("window", " ")
        starts = F.sequence(F.lit(0), F.lit(length - size))
        found = windows.filter(F.col("length") == length).select(F.lit(length).alias("length"), F.explode(_runs_from(words, starts, size)).alias("run"))
        out = out.unionByName(found)
    return out.distinct()


def _sized(rows: DataFrame, count: int, most: int) -> DataFrame:
    return F.broadcast(rows) if count <= most else rows


def _marks(docs: DataFrame, lengths: list[int], n: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n_words, length, run, at, near_first, near: one row per document (length 0) and per run to look up."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = computed_once(rows, words=words_of(F.col("text"))).select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words")
    around = n  # words before and after a piece that its windows can reach
    begins = F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 1, F.lit(0)), F.lit(PIECE))

    def piece(begin: Column) -> Column:
        first = F.greatest(begin - around, F.lit(0))
        return F.struct(begin.alias("begin"), first.alias("first"), F.slice("words", first + 1, F.lit(PIECE + 2 * around)).alias("some"))

    pieces = rows.select("row", "doc_id", "n_words", F.explode(F.transform(begins, piece)).alias("p")).select("row", "doc_id", "n_words", "p.*")

    def mark(length, run: Column, at: Column, near_first: Column, near: Column) -> Column:
        return F.struct(F.lit(length).alias("length"), run.alias("run"), at.alias("at"), near_first.alias("near_first"), near.alias("near"))

    head = mark(0, F.lit(0).cast("long"), F.lit(-1), F.lit(0), F.array().cast("array<string>"))
    found = [F.when(F.col("begin") == 0, F.array(head)).otherwise(F.array().cast("array<struct<length:int,run:bigint,at:int,near_first:int,near:array<string>>>"))]

    def marks_of(length: int) -> Column:
        stride = _stride(length)
        size = length - stride + 1
        start = F.col("begin") + F.pmod(-F.col("begin"), F.lit(stride))
        last = F.least(F.col("begin") + PIECE - 1, F.col("n_words").cast("int") - size)
        starts = F.when(last >= start, F.sequence(start, last, F.lit(stride))).otherwise(F.array().cast("array<int>"))

        def one(at: Column) -> Column:
            near_first = F.greatest(at - (stride - 1), F.lit(0))
            near = F.slice("some", near_first - F.col("first") + 1, at - near_first + F.lit(length))
            return mark(length, _run(F.col("some"), at - F.col("first"), size), at, near_first, near)

        return F.transform(starts, one)

    found += [marks_of(length) for length in lengths]
    marks = pieces.select("row", "doc_id", F.when(F.col("begin") == 0, F.col("n_words")).alias("n_words"), F.explode(F.concat(*found)).alias("m"))
    return marks.select("row", "doc_id", "n_words", "m.*")


def _occurrences(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words of every document), (row, at, length, items of every occurrence of a window)."""
    if n < 1:
        raise ValueError("a window has one word at least")
    windows = windows_of(items, n, item_col=item_col, text_col=item_text_col)
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # n rows at most
    runs = workspace.materialize(_runs(windows, lengths), "benchmark-runs")
    marks = _marks(docs, lengths, n, id_col, text_col)
    hits = workspace.materialize(marks.join(_sized(runs, runs.count(), BROADCAST_RUNS), ["length", "run"], "left_semi"), "contamination-hits")
    every = hits.filter("length = 0").select("row", "doc_id", "n_words")
    near = hits.filter("length > 0")
    size = F.size("near")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(size - F.col("length"), F.lit(0))), lambda k: k + F.col("length") <= size)
    near = near.select("row", "length", "near_first", "near", F.explode(starts).alias("k"))
    near = near.select("row", "length", (F.col("near_first") + F.col("k")).alias("at"), lowered(F.array_join(F.slice("near", F.col("k") + 1, F.col("length")), " ")).alias("window"))
    found = near.join(_sized(windows, windows.count(), BROADCAST_WINDOWS), ["window", "length"])
    return every, workspace.materialize(found.select("row", "at", "length", "items"), "contamination-found")


def _covered(found: DataFrame) -> DataFrame:
    """row, place: each word that an occurrence covers, once."""
    return found.select("row", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("place")).distinct()


def findings(docs: DataFrame, items: DataFrame, n: int = N, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    every, found = _occurrences(docs, items, n, id_col, text_col, item_col, item_text_col)
    return _counted(every, found).drop("row")


def _counted(every: DataFrame, found: DataFrame) -> DataFrame:
    hit = _covered(found).groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("named"))
    out = every.join(hit, "row", "left").join(named, "row", "left")
    digest = F.sha2(F.encode(F.coalesce(F.array_join("named", ","), F.lit("")), "UTF-8"), 256)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("named"), F.lit(0)).cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: its own identifier, else numbers in a written table."""
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(f"`{id_col}`")).alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        return docs, id_col
    key = unused(docs.columns, "scan_row")
    return workspace.materialize(docs.withColumn(key, F.monotonically_increasing_id()), "contamination-numbered"), key


def without_documents(docs: DataFrame, items: DataFrame, n: int = N, *, id_col="doc_id", text_col="text", least_share: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` of whose words no window, or not more than ``least_share``, covers any."""
    columns = docs.columns
    docs, key = _keyed(docs, id_col)
    bad = findings(docs, items, n, id_col=key, text_col=text_col, **options).filter((F.col("n_hit") > 0) & (F.col("n_hit") > least_share * F.col("n_words")))
    mine = unused(columns, "hit_id")
    bad = bad.select(F.col("doc_id").alias(mine))
    return docs.join(bad, F.col(f"`{key}`").cast("long") == F.col(mine), "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def without_spans(docs: DataFrame, items: DataFrame, n: int = N, *, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """All rows of ``docs``; texts lose the words that a window covers, each with the gap after it.

    Clean texts stay as they are.  The places of a document's hits are one array, at most one number for
    each of its words.
    """
    columns = docs.columns
    docs, key = _keyed(docs, id_col)
    every, found = _occurrences(docs, items, n, key, text_col, options.get("item_col", "item_id"), options.get("item_text_col", "text"))
    mine, places = unused(columns, "hit_id"), unused(columns, "hit_places")
    places_of = _covered(found).groupBy("row").agg(F.collect_list("place").alias(places)).join(every.select("row", F.col("doc_id").alias(mine)), "row").drop("row")
    text = F.col(f"`{text_col}`")
    joined = docs.join(places_of, F.col(f"`{key}`").cast("long") == F.col(mine), "left")
    tokens = unused([*columns, mine, places], "hit_tokens")
    joined = computed_once(joined, **{tokens: F.when(F.col(places).isNotNull(), F.regexp_extract_all(text, F.lit(WORD + GAP), F.lit(0)))})
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(tokens) - 1), F.col(places)))
    cut = F.concat(F.regexp_extract(text, "^" + GAP, 0), F.array_join(F.transform(kept, lambda k: F.get(F.col(tokens), k)), ""))
    return joined.select(*[F.when(F.col(places).isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns])
