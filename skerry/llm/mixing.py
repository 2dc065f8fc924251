"""Mixing sources to target weights.

Each source's documents are put in a hash order and their words packed into blocks of a fixed
length.  Every output shard draws multinomial source counts; a source's slots are numbered over all
shards, mapped through pseudorandom permutations of its block indexes (one permutation for each
pass over the source), and joined to the blocks by index.

The multinomial of a shard is over what is still owed to each source, so that the shards together
take exactly the rounded target of blocks and no source is passed through more than three times.

Everything that grows with the corpus is a DataFrame; the driver holds one row per source (targets are
a matter of all sources at once) and, as arrays, one number per (shard, source).  The table of sources is
broadcast behind a check of its size.  A hot source is spread over hash buckets for its prefix sums and
over block indexes for the joins, so no task holds a source.  A source with a target takes one block
at least, however small it is.

Defined results: a null text has size 0 and takes nothing; a null source is a source, ordered last;
documents with equal identifiers are separate rows, each with its own share of the mix; of documents
whose hash places are equal the smaller identifier, then size, then the first row precedes; an empty table
gives an empty result; further columns are ignored by :class:`Mix` and kept by :func:`mixed_documents`,
whatever their names; a text of any length is counted, and cut into words once, as a whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import workspace
from skerry.llm._columns import computed_once, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: A source's target is at most so many times its size.
MOST = 3
ROUNDS = 16
SLOTS_PER_ROW = 65_536
SLOTS_PER_TASK = 200_000
MOST_SLOT_TASKS = 20_000
ROWS_PER_BUCKET = 20_000
#: Sources that may be broadcast; names of some 100 bytes make 10 MB.
BROADCAST_SOURCES = 100_000

SOURCE_SCHEMA = "source string, source_ix int, source_size long, target double, blocks long"
DRAW_SCHEMA = "shard int, source_ix int, first long, slots long, blocks long"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[int], most: float = MOST) -> list[float]:
    """Share the sum of ``sizes`` by weight; excess over ``most`` sizes is shared again by weight."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        out = [float(most * s) if c else left * w / weight for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > most * s for s, t, c in zip(sizes, out, capped)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over)]


def shard_draws(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: each shard is a multinomial over what is owed; columns sum to quotas."""
    owed = np.array(quotas, dtype=np.int64)
    total = int(owed.sum())
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    for j in range(shards):
        rng = np.random.Generator(np.random.Philox(key=[seed, j]))
        need = total * (j + 1) // shards - total * j // shards
        while need:
            take = np.minimum(rng.multinomial(need, owed / owed.sum()), owed)
            out[j] += take
            owed -= take
            need -= int(take.sum())
    return out


def permuted(index: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed pseudorandom permutation of [0, size), for any size: the swap-or-not shuffle."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        swap = F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, step)


class Mix:
    """The tables of a mix.

    ``sources``: source, source_ix, source_size, target, blocks (one row per source).
    ``documents``: doc_id, source, size, row, source_ix, source_size, target, start (word offset in the source).
    ``slots``: shard, source_ix, slot, block (one row per slot of the output).
    ``pieces``: row, doc_id, block, from_word, words, times (parts of documents that lie in taken blocks).
    """

    def __init__(self, docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", block_words=32, output_shards=64, seed=7):
        self.block_words, self.output_shards, self.seed = block_words, output_shards, seed
        spark = self.spark = docs.sparkSession
        doc_id = F.col(id_col).cast("long")
        sized = docs.select(
            doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
            F.monotonically_increasing_id().alias("row"), F.xxhash64(F.lit(seed), doc_id).alias("place"), F.xxhash64(F.lit(1), doc_id, F.col(text_col)).alias("spread"),
        )
        sized = workspace.materialize(sized, "mix-sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
        totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        self.sources = self._sources(spark, totals)
        self.documents = self._placed(sized, sum(r["rows"] for r in totals))
        self._draws()

    def _sources(self, spark: SparkSession, totals: list) -> DataFrame:
        sizes = [r["size"] for r in totals]
        goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]) if sum(sizes) else [0.0] * len(sizes)
        blocks = [-(-s // self.block_words) for s in sizes]
        self._known = [(r["source"], i, s, t, b) for i, (r, s, t, b) in enumerate(zip(totals, sizes, goal, blocks))]
        return spark.createDataFrame(self._known, SOURCE_SCHEMA)

    def _placed(self, sized: DataFrame, rows: int) -> DataFrame:
        """Word offsets within the source: a prefix sum over hash buckets, then one within each."""
        buckets = max(64, rows // ROWS_PER_BUCKET)
        source = self.sources.withColumnRenamed("source", "known")
        source = F.broadcast(source) if len(self._known) <= BROADCAST_SOURCES else source
        sized = sized.join(source, F.col("source").eqNullSafe(F.col("known"))).drop("known")
        sized = sized.withColumn("bucket", F.pmod("spread", F.lit(buckets)))  # also rows of one identifier, or of none, are spread
        by = sized.groupBy("source_ix", "bucket").agg(F.sum("size").alias("in_bucket"))
        before = Window.partitionBy("source_ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        by = by.select("source_ix", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("source_ix", "bucket").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
        placed = sized.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0))).join(by, ["source_ix", "bucket"])
        placed = placed.select("doc_id", "source", "size", "row", "source_ix", "source_size", "target", (F.col("base") + F.col("offset")).alias("start"))
        return workspace.materialize(placed, "mix-placed")

    def _draws(self) -> None:
        spark, known = self.spark, self._known
        quotas = [max(1, round(t * b / s)) if s and t else 0 for _, _, s, t, b in known]
        counts = shard_draws(quotas, self.output_shards, self.seed) if sum(quotas) else np.zeros((0, len(known)), dtype=np.int64)
        firsts = np.cumsum(counts, axis=0) - counts
        shard, ix = np.nonzero(counts)
        of_source = np.array([k[4] for k in known], dtype=np.int64)
        # As plain rows: with a table of known size the slots that come of it would count as small, and be broadcast.
        rows = zip(*[c.tolist() for c in (shard, ix, firsts[shard, ix], counts[shard, ix], of_source[ix])])
        self.draws = spark.createDataFrame(list(rows), DRAW_SCHEMA)
        parts = self.draws.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {SLOTS_PER_ROW}"))).alias("part"))
        # A number of partitions of its own: these few rows become many slots, which AQE can't foresee.
        parts = parts.repartition(min(MOST_SLOT_TASKS, max(8, sum(quotas) // SLOTS_PER_TASK)), "shard", "source_ix", "part")
        last = F.least(F.col("slots"), (F.col("part") + 1) * SLOTS_PER_ROW) - 1
        slots = parts.select("shard", "source_ix", "blocks", F.explode(F.sequence(F.col("first") + F.col("part") * SLOTS_PER_ROW, F.col("first") + last)).alias("slot"))
        turn = F.expr("slot div blocks")
        self.slots = slots.select(
            "shard", "source_ix", "slot", permuted(F.expr("slot % blocks"), F.col("blocks"), F.xxhash64(F.lit(self.seed), "source_ix", turn)).alias("block")
        )
        b = self.block_words
        of = self.documents.filter("size > 0")
        of = of.select("row", "doc_id", "source_ix", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        from_word = F.greatest(F.col("block") * b - F.col("start"), F.lit(0))
        to_word = F.least((F.col("block") + 1) * b - F.col("start"), F.col("size"))
        of = of.select("row", "doc_id", "source_ix", "block", from_word.alias("from_word"), (to_word - from_word).alias("words"))
        times = self.slots.groupBy("source_ix", "block").agg(F.count(F.lit(1)).alias("times"))
        self.pieces = of.join(times, ["source_ix", "block"])

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per document."""
        took = self.pieces.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        out = self.documents.join(took, "row", "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))

    def spans(self) -> DataFrame:
        """doc_id, from_word, words, copies: what the mix takes of each document, as few runs of words.

        The k-th layer of a document has the pieces taken at least k times; neighbouring pieces of a
        layer are one run.
        """
        layers = self.pieces.select("row", "doc_id", "block", "from_word", "words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("layer"))
        near = Window.partitionBy("row", "layer").orderBy("block")
        layers = layers.withColumn("run", F.col("block") - F.row_number().over(near))
        return layers.groupBy("row", "doc_id", "layer", "run").agg(F.min("from_word").alias("from_word"), F.sum("words").alias("words")).drop("run")


def mixed_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each row's text is a run of words that the mix takes.

    Runs that cover a document keep its text as it is.  ``n_chars``, if there, is the text's new length.
    The texts are joined to the runs by identifier.  Where identifiers repeat or are null, the rows are
    numbered first, in a written table, and joined by their number, so each row gets its own runs.
    """
    columns, schema = docs.columns, docs.schema
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(f"`{id_col}`")).alias("ids")).first()
    if ids["rows"] != ids["ids"]:
        key = unused(columns, "mix_row")
        docs, id_col = workspace.materialize(docs.withColumn(key, F.monotonically_increasing_id()), "mix-numbered"), key
    mix = Mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # All runs of a document in one row: at most three for each of its blocks.
    runs = mix.spans().groupBy("row", "doc_id").agg(F.collect_list(F.struct("from_word", "words")).alias("runs"))
    sizes = mix.documents.select(F.col("row").alias("of_row"), "size")
    runs = runs.join(sizes, F.col("row") == F.col("of_row")).select(F.col("doc_id").alias("run_id"), "runs", "size")
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col], F.lit(0).alias(unused(columns, "none")))
    texts = docs.select(rest.alias("rest"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_key"))
    joined = texts.join(runs, F.col("doc_key").eqNullSafe(F.col("run_id"))).drop("doc_key", "run_id")
    cut = F.exists("runs", lambda r: r["words"] < F.col("size"))
    words = F.when(cut, F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)))
    joined = computed_once(joined, cut_words=words)

    def text_of(run: Column) -> Column:
        part = F.array_join(F.slice("cut_words", (run["from_word"] + 1).cast("int"), run["words"].cast("int")), "")
        return F.when(run["words"] == F.col("size"), F.col("text")).otherwise(part)

    out = joined.select("rest", F.explode(F.transform("runs", text_of)).alias("mixed_text"))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("mixed_text").alias(name)
        if name == "n_chars":
            return F.length("mixed_text").cast(schema[name].dataType).alias(name)
        return F.col(f"rest.`{name}`").alias(name)

    return out.select(*[column(c) for c in columns])
