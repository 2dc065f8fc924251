"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import brown, chat, decontamination, divergence, exact_dedup, importance, licenses, matroska, mixing, packing, pseudonyms, quality, simhash

TOKENIZER = "word_bpe_49k.json"
#: The setting that holds the secret of pseudonyms, and what stands in for it where it is unset; anyone can invert the latter's.
PSEUDONYM_KEY, PUBLIC_KEY = "spark.skerry.pseudonym.key", "key of a demonstration"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = brown.train(docs.filter(~quality.in_fold(F.col("doc_id"), 1)))
    scored = brown.score(docs, model)
    return scored.withColumn("held_out", quality.in_fold(F.col("doc_id"), 1))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_documents(spark, sf_dir)).taken()


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = quality.train(docs, labels.filter(~quality.in_fold(F.col("doc_id"), 0)))
    scored = quality.score(docs, trees)
    return scored.select("doc_id", quality.in_fold(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_columns(_documents(spark, sf_dir), with_media=False).drop("media")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``secret`` says whether the key was a secret one, or the public one that hides nothing."""
    key = spark.conf.get(PSEUDONYM_KEY, PUBLIC_KEY)
    found = pseudonyms.findings(_documents(spark, sf_dir), key)
    kinds = F.array_join(F.array_sort(F.array_distinct("found.kind")), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), kinds.alias("kinds"), "text", F.lit(key != PUBLIC_KEY).alias("secret"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.rendered(told.unionByName(extra)))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.findings(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_brown": op2_brown,
    "op3_licenses": op3_licenses,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_matroska": op6_matroska,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_chat": op10_chat,
    "op11_importance": op11_importance,
    "op12_decontamination": op12_decontamination,
    "op13_divergence": op13_divergence,
}

_LOWER_SQL = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS_SQL = r"regexp_extract_all({}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE_SQL = "1 + (1000000000 * ({}::hugeint + 2)) // ({} + 2 * {})"

ORACLES: dict[str, str] = {
    "op12_decontamination": f"""
        with items as (select item_id::varchar as item, {_WORDS_SQL.format(_LOWER_SQL.format("text"))} as w from benchmark),
        windows as (
            select item, least(len(w), 10) as size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') as window
            from items, unnest(range(1, len(w) - least(len(w), 10) + 2)) r(k) where len(w) > 0
        ),
        sizes as (select distinct size from windows),
        docs as (select doc_id, {_WORDS_SQL.format(_LOWER_SQL.format("text"))} as w from documents),
        tokens as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k, len(w) as n from docs),
        runs as (
            select doc_id, k, size, string_agg(word, ' ') over (partition by doc_id, size order by k rows between current row and 9 following) as ahead, n
            from tokens, sizes
        ),
        placed as (select doc_id, k, size, array_to_string(string_split(ahead, ' ')[1:size], ' ') as window from runs where k + size - 1 <= n),
        found as (select doc_id, k, p.size, item from placed p join windows w on w.size = p.size and w.window = p.window),
        hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(k, k + size)) as place from found) group by 1),
        named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as named from (select distinct doc_id, item from found) group by 1)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(named, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs left join hit using (doc_id) left join named using (doc_id)
    """,
    "op13_divergence": f"""
        with docs as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS_SQL.format(_LOWER_SQL.format("text"))} as w from documents),
        groups as (select distinct lang, source from docs),
        tokens as (select doc, lang, source, unnest(w) as term from docs),
        terms as (select lang, term from tokens group by 1, 2 having count(distinct doc) >= 10),
        counts as (select lang, source, term, count(*) as n from tokens semi join terms using (lang, term) group by 1, 2, 3),
        v as (select lang, count(*) as v from terms group by 1),
        total as (select lang, source, sum(n) as total from counts group by 1, 2),
        cells as (
            select g.lang, g.source, t.term, coalesce(c.n, 0) as n, {_SHARE_SQL.format("coalesce(c.n, 0)", "coalesce(x.total, 0)", "v.v")} as p
            from groups g join terms t on t.lang = g.lang join v on v.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = t.term
            left join total x on x.lang = g.lang and x.source = g.source
        ),
        whole as (select c.lang, term, {_SHARE_SQL.format("sum(n)", "max(t.total)", "max(v.v)")} as q from counts c join v using (lang) join (select lang, sum(n) as total from counts group by 1) t using (lang) group by 1, 2),
        pairs as (
            select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
            from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
        ),
        every as (select a.lang, a.source, b.source as item from groups a join groups b on a.lang = b.lang and a.source <> b.source),
        parts as (
            select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value from every left join pairs using (lang, source, item)
            union all
            select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from cells join whole using (lang, term) where n > 0 and p > q
        )
        select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
        from parts qualify part = 'pair' or rank <= 10
    """,
    "op1_exact_dedup": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
            from documents
        )
        select doc_id,
               first_value(doc_id) over w as keep_id,
               count(*) over (partition by norm) as group_size,
               row_number() over w = 1 as kept,
               sha256(norm) as text_sha256
        from d window w as (partition by norm order by n desc, doc_id rows between unbounded preceding and unbounded following)
    """,
}
