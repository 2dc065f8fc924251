"""License scans: MinHash bands over overlapping windows, then exact shingle containment (native).

Words are runs of letters and digits in lower case; a shingle is five of them, as a 64-bit hash.
For a template of ``n`` shingles, windows of ``n + stride - 1`` shingles start at every
``stride``-th one (``stride`` a quarter of ``n``), so every stretch of ``n`` shingles lies whole in a
window.  A window that holds 0.8 of the template has a Jaccard similarity of at least
``0.8 n / (n + stride - 1 + 0.2 n)``, over 0.55; with 16 bands of one MinHash each, at least one
band meets with a probability of over 0.99999.  Retrieved templates are verified by exact shingle
containment.

Windows without any shingle of a template of their length can't hold one and aren't formed: the documents'
shingles are joined to the templates', both as tables, so the plan doesn't grow with the templates.  Only
the numbers of windows are written for that; a second pass forms them in the documents that have any.
Documents with none of the words that every template shingle has at least one of are left before that.
The templates are a parameter, and their bands a broadcast table of templates x bands rows;
``MOST_TEMPLATES`` bounds it.

Defined results: a null or empty text has no findings, nor has one with fewer words than any template or notice; a null
identifier is kept; repeated rows give repeated findings; an empty table gives an empty result;
further columns are ignored.  Texts with fewer than five words are refused among ``templates`` and
passed as ``notices``: such a text is one shingle of all its words, found where these follow each other.  A text of any length is scanned as a whole; of windows that hold
equal shares the first counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry import workspace
from skerry.llm._columns import computed_once
from skerry.llm.templates import NOTICES, TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 16
MOST_TEMPLATES = 2_000
#: Template shingles that may be broadcast, 16 bytes each; beyond that the join is shuffled.
BROADCAST_SHINGLES = 1_000_000
#: Windows and texts around template shingles that may be broadcast, 32 bytes each at most.
BROADCAST_STARTS = 500_000
#: A search for more words than these costs more than hashing all documents.
MOST_ANCHORS = 512


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Hashes of the runs of five words, in order; empty for fewer words."""
    last = F.size(words) - (SHINGLE - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def signature(shingles: Column, bands: int) -> Column:
    """One MinHash per band."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda j: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, j))))


def stride_of(n: Column) -> Column:
    """From one window's start to the next, for templates of ``n`` shingles."""
    return F.greatest(F.floor(n / 4), F.lit(1)).cast("int")


def window_of(n: Column) -> Column:
    return (n + stride_of(n) - 1).cast("int")


def _template_table(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """license, shingles (each once), n (with repeats)."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    if short := [name for name, text in templates.items() if len(re.findall(r"[^\W_]+", text)) < SHINGLE]:
        raise ValueError(f"templates with fewer than {SHINGLE} words: {short}")
    table = docs.sparkSession.createDataFrame(list(templates.items()), "license string, body string")
    shingles = shingles_of(words_of(F.col("body")))
    return table.select("license", F.array_distinct(shingles).alias("shingles"), F.size(shingles).alias("n"))


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every shingle of a template has at least one; long words, as they are rare in texts."""
    left: list[set[str]] = []
    for text in templates.values():
        words = re.findall(r"[^\W_]+", text.lower())
        left += [{w for w in words[k : k + SHINGLE]} for k in range(len(words) - SHINGLE + 1)]
    left = [{w for w in s if len(w) >= 6} or {max(s, key=lambda w: (len(w), w))} for s in left]
    out: list[str] = []
    while left:
        count: dict[str, int] = {}
        for s in left:
            for w in s:
                count[w] = count.get(w, 0) + 1
        best = max(count, key=lambda w: (count[w], w))
        out.append(best)
        left = [s for s in left if best not in s]
    return sorted(out)


def _notices(docs: DataFrame, notices: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """The findings of texts with fewer than five words."""
    words = {name: re.findall(r"[^\W_]+", text.lower()) for name, text in notices.items()}
    if wrong := [name for name, w in words.items() if not 0 < len(w) < SHINGLE]:
        raise ValueError(f"notices without words or with {SHINGLE} and more: {wrong}")
    gap, lower = r"[^\p{L}\p{N}]+", F.lower(F.col(text_col))
    phrases = "|".join(gap.join(re.escape(x) for x in w) for w in words.values())
    rows = docs.filter(lower.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{phrases})(?![\p{{L}}\p{{N}}])"))
    rows = computed_once(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words=words_of(F.col("text")))

    def found(name: str, w: list[str]) -> Column:
        want = F.array(*[F.lit(x) for x in w])
        starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (len(w) - 1), F.lit(1)))
        return F.struct(F.lit(name).alias("license"), F.filter(starts, lambda i: F.slice("words", i, len(w)) == want).alias("places"))

    rows = rows.select("doc_id", F.explode(F.array(*[found(*item) for item in words.items()])).alias("f")).select("doc_id", "f.*").filter(F.size("places") > 0)
    return rows.select("doc_id", "license", F.lit(1.0).alias("containment"), (F.get("places", F.lit(0)) - 1).cast("long").alias("first_word"), F.size("places").cast("long").alias("n_windows"))


def _starts(rows: DataFrame, table: DataFrame) -> tuple[DataFrame, bool]:
    """(key, starts): numbers of the windows around template shingles, by text key; and whether all of it may be broadcast.

    The key is a hash of the text.  Texts that shared one would get each other's windows, too, which hold
    no template: they change nothing.
    """
    wanted = table.select("n", F.explode("shingles").alias("s")).distinct()
    places = computed_once(rows.select("key", "text"), words=words_of(F.col("text"))).select("key", F.posexplode(shingles_of(F.col("words"))).alias("i", "s"))
    places = places.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_SHINGLES else wanted, "s")
    stride = stride_of(F.col("n"))
    first = F.greatest(F.ceil((F.col("i") - window_of(F.col("n")) + 1) / stride).cast("int"), F.lit(0))
    starts = places.select("key", "n", F.explode(F.sequence(first, F.floor(F.col("i") / stride).cast("int"))).alias("k"))
    # A group holds some of the windows of one text.
    starts = workspace.materialize(starts.groupBy("key").agg(F.collect_set(F.struct("n", "k")).alias("starts")), "license-starts")
    size = starts.agg(F.coalesce(F.sum(F.size("starts") + 1), F.lit(0))).first()[0]
    return starts, size <= BROADCAST_STARTS


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, notices: dict[str, str] | None = None, containment: float = CONTAINMENT, bands: int = BANDS, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, license, containment, first_word, n_windows: one row per document row and template found in it.

    ``first_word`` is where the best window starts, counted from 0.  ``notices`` are texts of one to four
    words; those of this package go with its own templates.
    """
    if notices is None:
        notices = NOTICES if templates is TEMPLATES else {}
    if len(templates) + len(notices) > MOST_TEMPLATES or set(templates) & set(notices):
        raise ValueError(f"more than {MOST_TEMPLATES} templates and notices, or a name in both")
    table = _template_table(docs, templates)
    rows = docs
    # A document with a template's shingle has one of the anchors: the others needn't be hashed.
    if len(words := anchors(templates)) <= MOST_ANCHORS:
        word = "|".join(re.escape(w) for w in words)
        rows = rows.filter(F.lower(F.col(text_col)).rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{word})(?![\p{{L}}\p{{N}}])"))
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    starts, small = _starts(rows, table)
    rows = rows.join(F.broadcast(starts) if small else starts, "key").withColumn("row", F.monotonically_increasing_id())
    rows = computed_once(computed_once(rows, words=words_of(F.col("text"))), all=shingles_of(F.col("words"))).select("doc_id", "row", "all", "starts")
    start = F.col("s.k") * stride_of(F.col("s.n"))
    windows = rows.select("doc_id", "row", "all", F.explode("starts").alias("s"))
    windows = windows.select("doc_id", "row", F.col("s.n").alias("n"), start.alias("first"), F.slice("all", start + 1, window_of(F.col("s.n"))).alias("window"))
    windows = windows.select("*", F.posexplode(signature(F.col("window"), bands)).alias("band", "least"))
    bands_of = table.select("license", "shingles", "n", F.posexplode(signature(F.col("shingles"), bands)).alias("band", "least"))
    found = windows.join(F.broadcast(bands_of), ["n", "band", "least"])
    share = F.size(F.array_intersect("shingles", "window")) / F.size("shingles")
    found = found.select("doc_id", "row", "license", "first", share.alias("containment")).filter(F.col("containment") >= containment)
    best = F.max(F.struct(F.col("containment"), (-F.col("first")).alias("neg")))
    found = found.groupBy("row", "doc_id", "license").agg(best.alias("best"), F.count_distinct("first").alias("n_windows"))
    found = found.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.neg")).cast("long").alias("first_word"), "n_windows")
    return found.unionByName(_notices(docs, notices, id_col, text_col)) if notices else found
