"""The registered queries and their SQL.

Every query runs over its whole tables.  Derived doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import workspace
from skerry.functions import labels as answer_labels
from skerry.functions import text as tx
from skerry.operators import agreement, cell_index, chunking, corpus, metrics, pooling, sampling, statistics, vector_search
from skerry.plans import experiment
from skerry.schemas import VARIANTS
from skerry.sources import pages as html_pages
from skerry.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EVERY = 100  # the search's stated query set: vectors whose identifier it divides, against all vectors
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
MOST_WORDS, LEAST_COSINE = 0.35, 0.25  # from where the rule judges call a text relevant
PARTS = {"baseline": (1, 64), "qr_only": (1, 32), "hq_only": (33, 32), "both": (17, 32)}
"""Variants of the vector search: first coordinate and number of coordinates."""


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- vector search and ranked-list metrics -------------------------------------------------------


def _vector_hits(spark: SparkSession, sf_dir: str, first: int = 1, count: int = 64, k: int = 10, method=vector_search.topk_native) -> DataFrame:
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.slice("embedding", first, count).alias("vector"))
    queries = vectors.filter(F.col("item_id") % EVERY == 0).withColumnRenamed("item_id", "query_id")
    return method(queries, vectors, k, exclude_self=True)


def _label_scores(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """Scores of hits among vectors, where the query's label is what it should find."""
    labels = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    asked = labels.filter(F.col("item_id") % EVERY == 0).withColumnRenamed("item_id", "query_id")
    return metrics.of_labels(hits, labels, asked)


def _hits_sql(name: str = "hits", first: int = 1, count: int = 64) -> str:
    return f"""
        {name}_v as (select vec_id, embedding[{first}:{first + count - 1}]::double[] as e, label from embeddings),
        {name} as (
            select q.vec_id as query_id, d.vec_id as item_id, list_cosine_similarity(q.e, d.e) as score,
                   row_number() over (partition by q.vec_id order by list_cosine_similarity(q.e, d.e) desc, d.vec_id) as rank
            from {name}_v q join {name}_v d on q.vec_id % {EVERY} = 0 and q.vec_id <> d.vec_id
            qualify rank <= 10
        )"""


_GOLD_SQL = f"""
        gold as (select q.vec_id as query_id, d.vec_id as item_id from embeddings q join embeddings d using (label) where q.vec_id % {EVERY} = 0 and q.vec_id <> d.vec_id),
        sizes as (select query_id, count(*) as n_gold from gold group by 1)"""


_IDEAL = "list_sum(list_transform(range(1, least(10, n_gold)::bigint + 1), lambda i: 1.0 / log2(i + 1)))"


def _scores_sql(hits: str = "hits") -> str:
    return f"""
            select query_id, n_gold, h5 / n_gold as recall_at_5, h10 / n_gold as recall_at_10, mrr, dcg / {_IDEAL} as ndcg_at_10
            from (
                select h.query_id, max(s.n_gold) as n_gold,
                       count(g.item_id) filter (where h.rank <= 5) as h5, count(g.item_id) filter (where h.rank <= 10) as h10,
                       coalesce(1.0 / min(h.rank) filter (where g.item_id is not null), 0.0) as mrr,
                       coalesce(sum(1.0 / log2(h.rank + 1)) filter (where g.item_id is not null and h.rank <= 10), 0.0) as dcg
                from {hits} h left join gold g on g.query_id = h.query_id and g.item_id = h.item_id join sizes s on s.query_id = h.query_id
                group by h.query_id
            )"""


@register(f"with {_hits_sql()} select query_id, item_id, rank, round(score, 6) as score from hits")
def topk_cosine(spark, sf_dir):
    return _vector_hits(spark, sf_dir).select("query_id", "item_id", "rank", _r("score"))


@register(f"with {_hits_sql()} select query_id, item_id, rank, round(score, 6) as score from hits")
def topk_cosine_block(spark, sf_dir):
    return _vector_hits(spark, sf_dir, method=vector_search.topk_block).select("query_id", "item_id", "rank", _r("score"))


def _cells(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    return cell_index.CellIndex.build(items, block_rows=64).search(queries, k, exclude_self)


@register(f"with {_hits_sql()} select query_id, item_id, rank, round(score, 6) as score from hits")
def topk_cosine_cells(spark, sf_dir):
    """By an inverted file, whose blocks are small enough here that some can be left out."""
    return _vector_hits(spark, sf_dir, method=_cells).select("query_id", "item_id", "rank", _r("score"))


def _scores(spark, sf_dir) -> DataFrame:
    return _label_scores(spark, sf_dir, _vector_hits(spark, sf_dir).withColumn("variant", F.lit("baseline")))


_ROUNDED = "round(recall_at_5, 6) as recall_at_5, round(recall_at_10, 6) as recall_at_10, round(mrr, 6) as mrr, round(ndcg_at_10, 6) as ndcg_at_10"
_METRICS = ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")


@register(f"with {_hits_sql()}, {_GOLD_SQL} select query_id, n_gold, {_ROUNDED} from ({_scores_sql()})")
def recall_mrr_ndcg_per_query(spark, sf_dir):
    return _scores(spark, sf_dir).select("query_id", "n_gold", *[_r(m) for m in _METRICS])


@register(f"with {_hits_sql()}, {_GOLD_SQL} select {', '.join(f'round(avg({m}), 6) as {m}' for m in _METRICS)} from ({_scores_sql()})")
def metrics_mean(spark, sf_dir):
    return metrics.means(_scores(spark, sf_dir)).select(*[_r(m) for m in _METRICS])


@register(f"""
    with {_hits_sql()}, firsts as (select query_id, label, min(rank) as first from hits join embeddings on vec_id = item_id group by 1, 2)
    select query_id, label as item_id, row_number() over (partition by query_id order by first) as rank from firsts""")
def collapse_to_articles(spark, sf_dir):
    labels = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    hits = _vector_hits(spark, sf_dir).join(labels, "item_id").withColumn("variant", F.lit("v"))
    return metrics.collapsed(hits, F.col("label")).select("query_id", "item_id", "rank")


def _variant_scores(spark, sf_dir) -> DataFrame:
    """Scores of four searches, written: tests read them several times."""
    out = None
    for name, (first, count) in PARTS.items():
        hits = _vector_hits(spark, sf_dir, first, count).withColumn("variant", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    return workspace.materialize(_label_scores(spark, sf_dir, out), "variant-scores")


_VARIANT_SQL = "with " + ", ".join(_hits_sql(f"of_{n}", *p) for n, p in PARTS.items()) + f", {_GOLD_SQL}, scores as (" + " union all ".join(
    f"select '{n}' as variant, * from ({_scores_sql(f'of_{n}')})" for n in PARTS
) + ")"
_ORDER_SQL = "(values " + ", ".join(f"('{n}', {i})" for i, n in enumerate(PARTS)) + ") o(variant, place)"
_PAIRS_SQL = f"""{_VARIANT_SQL}, long as (
        select variant, query_id, 'recall_at_10' as metric, recall_at_10 as v from scores union all select variant, query_id, 'ndcg_at_10', ndcg_at_10 from scores
    ), o as (select * from {_ORDER_SQL}), pairs as (
        select l.variant as a, r.variant as b, l.metric, l.query_id, l.v as x, r.v as y
        from long l join long r using (metric, query_id) join o lo on lo.variant = l.variant join o ro on ro.variant = r.variant where lo.place < ro.place
    )"""


@register(f"{_VARIANT_SQL} select variant, {', '.join(f'round(avg({m}), 6) as {m}' for m in _METRICS)} from scores group by 1")
def variant_means(spark, sf_dir):
    return metrics.means(_variant_scores(spark, sf_dir)).select("variant", *[_r(m) for m in _METRICS])


_SIGNED_RANKS_SQL = f"""{_PAIRS_SQL}, d as (select *, round(x - y, 9) as d from pairs), k as (
        select *, abs(d) as size, count(*) over (partition by a, b, metric, d = 0, abs(d)) as t,
               rank() over (partition by a, b, metric, d = 0 order by abs(d)) as rk from d
    ), w as (
        select a, b, metric, count(*) as pairs, count(*) filter (where d <> 0) as n, avg(x) as mean_a, avg(y) as mean_b,
               coalesce(sum(rk + (t - 1) / 2) filter (where d > 0), 0.0) as plus, coalesce(sum(rk + (t - 1) / 2) filter (where d < 0), 0.0) as minus,
               coalesce(sum(t * t - 1) filter (where d <> 0), 0) as tied from k group by 1, 2, 3
    ), z as (
        select *, case when pairs >= 2 and n > 0 then least(plus, minus) else 0.0 end as statistic, pairs between 2 and 50 and n = pairs and tied = 0 as exact,
               (least(plus, minus) - n * (n + 1) / 4) / nullif(sqrt((n * (n + 1) * (2 * n + 1) - tied / 2) / 24), 0) as z from w
    )"""
# The normal distribution by its series, Student's by its finite sums, the signed ranks' by all signs.
_P_SQL = f"""{_SIGNED_RANKS_SQL}, signs as (
        select a, b, metric, n, statistic, unnest(range(0, (2 ** n)::bigint)) as mask from z where exact
    ), counted as (
        select a, b, metric, least(1.0, 2.0 * count(*) filter (where list_sum(list_transform(range(1, n + 1), lambda r: case when (mask >> (r - 1)::int) & 1 = 1 then r else 0 end)) <= statistic) / count(*)) as p
        from signs group by 1, 2, 3
    ), wilcoxon as (
        select z.*, case when exact then c.p when z is null then 1.0 else greatest(0.0, 1 - sqrt(2 / pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 200), lambda k:
               exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))) end as p
        from z left join counted c using (a, b, metric)
    ), m as (
        select a, b, metric, count(*) as n, avg(x - y) as m, stddev_samp(x - y) / sqrt(count(*)) as e, max(abs(x - y)) as most from pairs group by 1, 2, 3
    ), angle as (
        select *, n - 1 as df, atan(case when e > 0 then m / e else 1e300 end / sqrt(n - 1)) as theta from m
    ), student as (
        select a, b, metric, case when n < 2 or most = 0 then 1.0 when df % 2 = 1
               then 1 - 2 / pi() * (abs(theta) + coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: sin(abs(theta)) * cos(theta) ** (2 * k + 1) * sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)))), 0))
               else 1 - coalesce(list_sum(list_transform(range(0, df // 2), lambda k: sin(abs(theta)) * cos(theta) ** (2 * k) * exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()))), 0) end as p
        from angle
    )"""


@register(f"""{_SIGNED_RANKS_SQL} select a, b, metric, pairs, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, statistic, round(z, 6) as z from z""")
def wilcoxon_t_z(spark, sf_dir):
    # Sums of discounts come in any order: equal differences are made equal before they are ranked.
    parts = statistics.wilcoxon_parts(statistics.variant_pairs(_variant_scores(spark, sf_dir), list(PARTS)), digits=9)
    return parts.select("a", "b", "metric", "pairs", "n", _r("mean_a"), _r("mean_b"), "statistic", _r("z"))


@register(f"""{_PAIRS_SQL} select a, b, metric, count(*) as n, round(avg(x), 6) as mean_a, round(avg(y), 6) as mean_b,
        round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 6) as statistic from pairs group by 1, 2, 3""")
def ttest_t(spark, sf_dir):
    pairs = statistics.variant_pairs(_variant_scores(spark, sf_dir), list(PARTS))
    return statistics.ttest_parts(pairs).select("a", "b", "metric", "n", _r("mean_a"), _r("mean_b"), _r("statistic"))


_NATIONS_SQL = """best as (select n_nationkey, n_regionkey, (select avg(c_acctbal) from customer where c_nationkey = n_nationkey) as x, (select avg(s_acctbal) from supplier where s_nationkey = n_nationkey) as y from nation),
        pairs as (select n_regionkey as a, x, y, x - y as d from best where x is not null and y is not null)"""


@register(f"""with {_NATIONS_SQL}, ranked as (select a, d, rank() over (partition by a order by abs(d)) as rk from pairs),
        sums as (select a, count(*) as n, coalesce(sum(rk) filter (where d > 0), 0) as plus, coalesce(sum(rk) filter (where d < 0), 0) as minus from ranked group by 1),
        masks as (select a, n, least(plus, minus) as low, unnest(range(0, (2 ** n)::bigint)) as mask from sums),
        drawn as (select a, n, low, list_sum(list_transform(range(1, n + 1), lambda r: case when (mask >> (r - 1)::int) & 1 = 1 then r else 0 end)) as total from masks)
        select a::varchar as a, n as pairs, low::double as statistic, round(least(1.0, 2.0 * count(*) filter (where total <= low) / count(*)), 9) as p_value from drawn group by a, n, low""")
def signed_rank_exact(spark, sf_dir):
    """Mean balances of a nation's customers and suppliers, paired by region: few pairs, whose distribution is counted out."""
    means = [_t(spark, sf_dir, t).groupBy(F.col(f"{c}_nationkey").alias("n_nationkey")).agg(F.avg(f"{c}_acctbal").alias(v)) for t, c, v in (("customer", "c", "x"), ("supplier", "s", "y"))]
    rows = _t(spark, sf_dir, "nation").join(means[0], "n_nationkey").join(means[1], "n_nationkey")
    pairs = rows.select(F.col("n_regionkey").cast("string").alias("a"), F.lit("").alias("b"), F.lit("").alias("metric"), F.col("n_nationkey").alias("query_id"), "x", "y")
    return statistics.wilcoxon(pairs).select("a", "pairs", "statistic", F.round("p_value", 9).alias("p_value"))


@register(f"""{_P_SQL} select a, b, metric, pairs, n, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, statistic, round(p, 9) as p_value, p < 0.05 / 12 as significant from wilcoxon""")
def ablation_verdicts(spark, sf_dir):
    rows = statistics.ablation(_variant_scores(spark, sf_dir), list(PARTS), digits=9)
    return rows.select("a", "b", "metric", "pairs", "n", _r("mean_a"), _r("mean_b"), "statistic", F.round("p_value", 9).alias("p_value"), "significant")


@register(f"""{_P_SQL} select a, b, metric, round(w.p, 9) as p_wilcoxon, w.p < 0.05 / 12 as by_wilcoxon, round(t.p, 9) as p_ttest, t.p < 0.05 / 12 as by_ttest, (w.p < 0.05 / 12) <> (t.p < 0.05 / 12) as flipped
    from wilcoxon w join student t using (a, b, metric)""")
def test_robustness(spark, sf_dir):
    rows = statistics.robustness(statistics.variant_pairs(_variant_scores(spark, sf_dir), list(PARTS)), 12, digits=9)
    return rows.withColumns({p: F.round(p, 9) for p in ("p_wilcoxon", "p_ttest")})


@register(f"""{_P_SQL} select a, b, metric, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, statistic, round(p, 9) as p_value, p < 0.05 / 12 as significant,
        (select count(distinct query_id) from scores) as n_queries, 4 as n_variants, 'hash-64' as model from wilcoxon""")
def ablation_file(spark, sf_dir):
    """A run's ablation is written under its tag and read back."""
    scores = _variant_scores(spark, sf_dir)
    path = workspace.new_path(spark, "results")
    tests = statistics.ablation(scores, list(PARTS), digits=9)
    tables.write_ablation(metrics.means(scores), tests, scores.select("query_id").distinct().count(), 0, path, "large", {"embedding_model": "hash-64"})
    back = tables.read_ablation(spark, path, "large")
    rows = back.select(F.explode("comparisons").alias("c"), "n_queries", F.size("means").alias("n_variants"), F.col("run_config")["embedding_model"].alias("model")).select("c.*", "n_queries", "n_variants", "model")
    return rows.withColumns({"mean_a": _r("mean_a"), "mean_b": _r("mean_b"), "p_value": F.round("p_value", 9)})


@register(f"""{_VARIANT_SQL}, times as (select user_id as query_id, avg(value) as latency_ms, count(*) as tokens from events group by 1)
        select variant, {', '.join(f'round(avg({m}), 6) as {m}' for m in _METRICS)}, round(avg(latency_ms), 6) as avg_latency_ms, round(avg(tokens), 6) as avg_tokens, count(latency_ms) as timed
        from scores left join times using (query_id) group by 1""")
def run_metrics(spark, sf_dir):
    """A query's time and tokens are those of the events of its number; some have none."""
    times = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.avg("value").alias("latency_ms"), F.count(F.lit(1)).alias("tokens"))
    times = times.select(F.explode(F.lit(list(PARTS))).alias("variant"), "*")
    rows = metrics.timed(_variant_scores(spark, sf_dir), times)
    timed = rows.groupBy("variant").agg(F.count("latency_ms").alias("timed"))
    return metrics.run_metrics(rows).join(timed, "variant").select("variant", *[_r(m) for m in (*_METRICS, "avg_latency_ms", "avg_tokens")], "timed")


@register(f"""{_VARIANT_SQL}, d as (select s.variant, s.recall_at_10 - b.recall_at_10 as delta from scores s join scores b on b.query_id = s.query_id and b.variant = 'baseline' and s.variant <> 'baseline')
    select variant, count(*) filter (where delta > 1e-9) as better, count(*) filter (where delta < -1e-9) as worse, count(*) filter (where abs(delta) <= 1e-9) as same,
           round(coalesce(sum(delta) filter (where delta > 1e-9), 0.0), 6) as gained, round(coalesce(sum(delta) filter (where delta < -1e-9), 0.0), 6) as lost, round(avg(delta), 6) as mean_delta
    from d group by 1""")
def delta_better_worse_same(spark, sf_dir):
    counts = metrics.change_counts(metrics.deltas(_variant_scores(spark, sf_dir), "recall_at_10", "baseline"))
    return counts.select("variant", "better", "worse", "same", _r("gained"), _r("lost"), _r("mean_delta"))


@register(f"with {_hits_sql()}, {_GOLD_SQL} select query_id, round(recall_at_10, 6) as recall_at_10 from ({_scores_sql()}) order by round(recall_at_10, 6), query_id limit 10")
def worst_queries(spark, sf_dir):
    return _scores(spark, sf_dir).select("query_id", _r("recall_at_10")).orderBy("recall_at_10", "query_id").limit(10)


# --- chunks ---------------------------------------------------------------------------------------


_CHUNK_SQL = """select doc_id::varchar || ':' || case when k < 10000 then lpad(k::varchar, 4, '0') else k::varchar end as chunk_id, k::int as position,
        (k * 800)::int as char_start, least(k * 800 + 1000, length(text))::int as char_end, substring(text, k * 800 + 1, 1000) as content
    from documents, unnest(range(0, greatest(ceil((length(text) - 1000) / 800), 0)::bigint + 1)) r(k) where length(text) > 0"""


def _chunks(spark, sf_dir, by_line: bool = False) -> DataFrame:
    return chunking.chunk(chunking.document_sections(_t(spark, sf_dir, "documents"), by_line))


@register(f"select chunk_id, position, char_start, char_end, md5(content) as content_md5 from ({_CHUNK_SQL})")
def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "position", "char_start", "char_end", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


@register("""
    with lines as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 as sec from documents),
    w as (select doc_id, sec, k, line from lines, unnest(range(0, greatest(ceil((length(line) - 1000) / 800), 0)::bigint + 1)) r(k))
    select doc_id::varchar as pmid, (row_number() over (partition by doc_id order by sec, k) - 1)::int as position, 's' || sec::varchar as section, (k * 800)::int as char_start, md5(substring(line, k * 800 + 1, 1000)) as content_md5 from w""")
def chunk_sections(spark, sf_dir):
    return _chunks(spark, sf_dir, True).select("pmid", "position", "section", "char_start", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


@register(f"""with parts as (select doc_id, 0 as sec, 'Languages' as section, lang || '/' || source as part from documents union all select doc_id, 1, 'Text', coalesce(text, '') from documents),
    w as (select doc_id, sec, section, k, part from parts, unnest(range(0, greatest(ceil((length(part) - 1000) / 800), 0)::bigint + 1)) r(k) where part <> '')
    select doc_id::varchar as pmid, (row_number() over (partition by doc_id order by sec, k) - 1)::int as position, section, (k * 800)::int as char_start, md5(substring(part, k * 800 + 1, 1000)) as content_md5 from w""")
def chunk_articles(spark, sf_dir):
    """Articles with an abstract and a body: positions count over both."""
    docs = _t(spark, sf_dir, "documents")
    abstract = F.array(F.struct(F.lit("Languages").alias("title"), F.concat_ws("/", "lang", "source").alias("text")))
    body = F.array(F.struct(F.lit("Text").alias("title"), F.coalesce("text", F.lit("")).alias("text")))
    rows = chunking.chunk(chunking.article_sections(docs.select(F.col("doc_id").cast("string").alias("pmid"), abstract.alias("abstract"), body.alias("body"))))
    return rows.select("pmid", "position", "section", "char_start", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


@register(f"select count(*) as chunks, count(distinct split_part(chunk_id, ':', 1)) as articles, round(avg(length(content)), 6) as mean_chars, max(position) as last_position from ({_CHUNK_SQL})")
def chunk_stats(spark, sf_dir):
    return _chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("pmid").alias("articles"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"), F.max("position").alias("last_position"))


_UUID_SQL = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(chunk_id))"


@register(f"""select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id
    from (select chunk_id, {_UUID_SQL} as h from ({_CHUNK_SQL}))""")
def point_ids_uuid5(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", tx.uuid5(NAMESPACE, F.col("chunk_id")).alias("point_id"))


@register(f"select chunk_id, sha256(encode('hash-64') || '\\x00'::blob || encode(content)) as cache_key from ({_CHUNK_SQL})")
def cache_keys(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", tx.cache_key(F.lit("hash-64"), F.col("content")).alias("cache_key"))


@register("select doc_id::varchar as pmid, length(text)::bigint as n_chars, greatest(ceil((length(text) - 1000) / 800), 0)::bigint + 1 as n_chunks from documents where length(text) > 0")
def chunk_index(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    index = chunking.chunk_index(chunks).select("pmid", F.size("chunk_ids").cast("long").alias("n_chunks"))
    ends = chunks.groupBy("pmid").agg(F.max("char_end").cast("long").alias("n_chars"))
    return index.join(ends, "pmid").select("pmid", "n_chars", "n_chunks")


# --- offline embedding, variants, pools ----------------------------------------------------------


def _enriched(text):
    """The text with one question about its first long word."""
    word = F.array(F.regexp_extract(F.lower(text), "[a-z]{8,}", 0))
    questions = F.transform(F.filter(word, lambda w: w != ""), lambda w: F.concat(F.lit("What is "), w, F.lit("?")))
    return F.get(F.transform(F.array(questions), lambda q: tx.enriched_text(text, q)), F.lit(0))


def _rewritten(text):
    """The whole text, each word of three letters and more followed by itself without its last one."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(F.length(w) >= 3, F.concat(w, F.lit(" "), F.left(w, F.length(w) - 1))).otherwise(w)), " ")


def _embed(rows: DataFrame) -> DataFrame:
    return vector_search.hash_embedding(rows, "item_id", F.col("text"))


def _asked(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), _rewritten(F.col("text")).alias("rewritten"))


def _content(spark, sf_dir) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), text.alias("content"), _enriched(text).alias("enriched"))


def _variant_hits(spark, sf_dir) -> DataFrame:
    """Four variants by two searches: a collection is embedded once and asked both kinds of questions together."""
    stores = experiment.collections(_content(spark, sf_dir), _embed)
    return workspace.materialize(experiment.retrieve(_asked(spark, sf_dir), stores, _embed), "variant-hits")


def _embed_sql(name: str, table: str, key: str, text: str) -> str:
    return f"""
        {name}_b as (select {key} as id, ('0x' || substr(md5(tok), 1, 4))::int % 64 as b, count(*)::bigint as n
            from (select {key}, unnest(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) as tok from {table}) group by 1, 2),
        {name} as (select id, b, n, sum(n * n) over (partition by id) as norm from {name}_b)"""


_RICH_SQL = "case when regexp_extract(lower(text), '[a-z]{8,}') = '' then text else text || chr(10) || 'What is ' || regexp_extract(lower(text), '[a-z]{8,}') || '?' end"
_NEW_SQL = "array_to_string(list_transform(string_split(text, ' '), lambda w: case when length(w) >= 3 then w || ' ' || left(w, length(w) - 1) else w end), ' ')"
_SPARSE = {(False, "d"): ("plain", "documents", "doc_id", "text"), (True, "d"): ("rich", "documents", "doc_id", _RICH_SQL), (False, "q"): ("asked", "benchmark", "item_id", "text"), (True, "q"): ("rewr", "benchmark", "item_id", _NEW_SQL)}


def _retrieved_sql(name: str, items: str, queries: str) -> str:
    return f"""{name} as (
            select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank
            from (select q.id as query_id, d.id as item_id, sum(q.n * d.n)::double / sqrt(max(q.norm)::double * max(d.norm)::double) as score from {queries} q join {items} d on q.b = d.b group by 1, 2)
            qualify rank <= 10)"""


_RETRIEVAL_SQL = "with " + ", ".join(_embed_sql(*x) for x in _SPARSE.values()) + ", " + ", ".join(
    _retrieved_sql(f"r_{n}", _SPARSE[rich, "d"][0], _SPARSE[new, "q"][0]) for n, (rich, new) in VARIANTS.items()
) + ", hits as (" + " union all ".join(f"select '{n}' as variant, * from r_{n}" for n in VARIANTS) + ")"


@register("with " + _embed_sql("e", "documents", "doc_id", "text") + " select id as item_id, b as bucket, n from e")
def hash_embedding(spark, sf_dir):
    vectors = _embed(_content(spark, sf_dir).select("item_id", F.col("content").alias("text"))).select("item_id", F.posexplode("vector").alias("bucket", "n"))
    return vectors.filter("n > 0").select("item_id", "bucket", F.col("n").cast("long").alias("n"))


@register(_RETRIEVAL_SQL + " select query_id, item_id, rank, round(score, 6) as score from hits where variant = 'baseline'")
def hash_retrieval_top10(spark, sf_dir):
    items = _embed(_content(spark, sf_dir).select("item_id", F.col("content").alias("text")))
    asked = _embed(_asked(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("question").alias("text"))).withColumnRenamed("item_id", "query_id")
    hits = vector_search.topk_block(workspace.materialize(asked, "asked"), items, 10)
    return hits.select("query_id", "item_id", "rank", _r("score"))


@register(_RETRIEVAL_SQL + " select variant, query_id, item_id, rank, round(score, 6) as score from hits")
def variant_retrieval(spark, sf_dir):
    return _variant_hits(spark, sf_dir).select("variant", "query_id", "item_id", "rank", _r("score"))


def _source_items(spark, sf_dir) -> DataFrame:
    """A benchmark item's source: the document of its number."""
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id"), F.lit(0).alias("pos"))


_POOL_SQL = _RETRIEVAL_SQL + """, firsts as (select query_id, item_id, min(kind) as kind from (select item_id as query_id, item_id, 0 as kind from benchmark union all select query_id, item_id, 1 from hits) group by 1, 2),
    pools as (select query_id, row_number() over (partition by query_id order by kind, item_id) - 1 as pos, item_id, kind = 0 as from_source from firsts)"""


@register(_POOL_SQL + " select query_id, pos, item_id, from_source from pools")
def variant_pool(spark, sf_dir):
    return pooling.pool(_source_items(spark, sf_dir), _variant_hits(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@register(_POOL_SQL + " select round(avg(n), 6) as mean_size, max(n) as max_size, count(*) as queries from (select query_id, count(*) as n from pools group by 1)")
def pool_size_stats(spark, sf_dir):
    return pooling.size_statistics(pooling.pool(_source_items(spark, sf_dir), _variant_hits(spark, sf_dir))).withColumn("mean_size", _r("mean_size"))


@register("""select b.item_id as query_id, coalesce(array_to_string(list(b.item_id::varchar || ':' || lpad(k::varchar, 4, '0') order by k) filter (where k is not null), ','), '') as item_ids
    from benchmark b left join (select doc_id, unnest(range(0, greatest(ceil((length(text) - 1000) / 800), 0)::bigint + 1)) as k from documents where length(text) > 0) d on d.doc_id = b.item_id * 7 group by 1""".replace("b.item_id::varchar || ':'", "(b.item_id * 7)::varchar || ':'"))
def source_chunks(spark, sf_dir):
    """A question's article is the document of seven times its number, which there may not be."""
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7).cast("string").alias("pmid"))
    found = pooling.source_chunks(asked, _chunks(spark, sf_dir).withColumnRenamed("chunk_id", "item_id"))
    return found.select("query_id", F.array_join("item_ids", ",").alias("item_ids"))


def _judged(spark, sf_dir) -> DataFrame:
    """Pool rows labelled by two rule judges and, where these differ, a third."""
    pool = workspace.materialize(pooling.pool(_source_items(spark, sf_dir), _variant_hits(spark, sf_dir)), "pool")
    docs = _content(spark, sf_dir).select("item_id", F.col("content").alias("body"))
    return _rule_judges(pool.join(docs, "item_id").join(_asked(spark, sf_dir).select("query_id", "question"), "query_id"))


def _rule_judges(rows: DataFrame) -> DataFrame:
    """Over whole texts: the share of the question's words that the body has; the cosine of both sets of words; the question as it stands."""
    rows = rows.withColumn("asked_words", F.array_distinct(vector_search.tokens(F.col("question")))).withColumn("body_words", F.array_distinct(vector_search.tokens(F.col("body"))))
    rows = rows.withColumn("both", F.size(F.array_intersect("asked_words", "body_words")))
    asked, body = F.size("asked_words"), F.size("body_words")
    a = F.col("both") / F.nullif(asked, F.lit(0)) >= MOST_WORDS
    b = F.col("both") / F.nullif(F.sqrt(asked.cast("double") * body), F.lit(0.0)) >= LEAST_COSINE
    return agreement.with_tiebreak(rows, a, b, F.contains(F.col("body"), F.col("question"))).drop("asked_words", "body_words", "both")


_WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"
_JUDGED_SQL = _POOL_SQL + f""", words as (
        select p.query_id, p.pos, p.item_id, d.text as body, q.text as question, {_WORDS_SQL.format("q.text")} as qw, {_WORDS_SQL.format("d.text")} as dw
        from pools p join documents d on d.doc_id = p.item_id join benchmark q on q.item_id = p.query_id
    ), judged as (
        select query_id, pos, item_id, coalesce(len(list_intersect(qw, dw)) / nullif(len(qw), 0) >= {MOST_WORDS}, false) as judge_a,
               coalesce(len(list_intersect(qw, dw)) / nullif(sqrt(len(qw)::double * len(dw)), 0) >= {LEAST_COSINE}, false) as judge_b, contains(body, question) as judge_c from words
    ), labelled as (select *, case when judge_a = judge_b then judge_a else judge_c end as final from judged)"""


@register(_JUDGED_SQL + " select query_id, item_id, judge_a, judge_b, final from labelled")
def judge_disagreements_tiebreak(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", "item_id", "judge_a", "judge_b", "final")


@register(_JUDGED_SQL + " select b.item_id as query_id, count(l.item_id) filter (where l.final) as gold_size from benchmark b left join labelled l on l.query_id = b.item_id group by 1")
def gold_sizes(spark, sf_dir):
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return agreement.gold_sizes(asked, _judged(spark, sf_dir))


@register(_JUDGED_SQL + " select count(*) as questions, count(*) filter (where n = 0) as empty from (select b.item_id, count(l.item_id) filter (where l.final) as n from benchmark b left join labelled l on l.query_id = b.item_id group by 1)")
def empty_gold_count(spark, sf_dir):
    return agreement.empty_gold(gold_sizes(spark, sf_dir))


@register(_JUDGED_SQL + " select query_id, array_to_string(list(item_id order by pos) filter (where final), ',') as relevant_ids from labelled group by 1 having count(*) filter (where final) > 0")
def gold_lists(spark, sf_dir):
    lists = agreement.gold_lists(_judged(spark, sf_dir)).filter(F.size("relevant_ids") > 0)
    return lists.select("query_id", F.array_join(F.col("relevant_ids").cast("array<string>"), ",").alias("relevant_ids"))


@register(_JUDGED_SQL + f""", gold as (select query_id, item_id from labelled where final), sizes as (select query_id, count(*) as n_gold from gold group by 1), {", ".join(f"h_{n} as (select * from hits where variant = '{n}')" for n in VARIANTS)}
        select variant, count(*) as queries, {", ".join(f"round(avg({m}), 6) as {m}" for m in _METRICS)} from ({" union all ".join(f"select '{n}' as variant, * from ({_scores_sql(f'h_{n}')})" for n in VARIANTS)}) group by 1""")
def experiment_means(spark, sf_dir):
    """The whole experiment on documents: collections, four variants, pool, judges, means."""
    def judge(rows: DataFrame) -> DataFrame:
        return _rule_judges(rows.withColumnRenamed("content", "body"))

    found = experiment.run(_content(spark, sf_dir), _asked(spark, sf_dir), _source_items(spark, sf_dir), _embed, judge)
    counts = found.per_query.groupBy("variant").agg(F.count(F.lit(1)).alias("queries"))
    return counts.join(found.means, "variant").select("variant", "queries", *[_r(m) for m in _METRICS])


@register("select d.doc_id from documents d anti join labels l using (doc_id)")
def missing_chunks_anti(spark, sf_dir):
    docs, known = (_t(spark, sf_dir, t).select(F.col("doc_id").alias("item_id")) for t in ("documents", "labels"))
    return pooling.missing(docs, known).withColumnRenamed("item_id", "doc_id")


@register("select d.doc_id from documents d semi join labels l using (doc_id)")
def semi_scored_ids(spark, sf_dir):
    docs, known = (_t(spark, sf_dir, t).select(F.col("doc_id").alias("query_id")) for t in ("documents", "labels"))
    return metrics.scorable(docs, known, known).withColumnRenamed("query_id", "doc_id")


# --- agreement, strata, samples -------------------------------------------------------------------

_KAPPA_SQL = """case when count(*) = 0 then 0.0 when avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) >= 1 then 1.0
        else (avg((quality = toxic)::int) - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)))) / nullif(1 - (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic))), 0) end"""
_STRATA_SQL = "strata as (select *, case when quality <> toxic then 'disagree' when quality = 1 then 'agree_rel' else 'agree_not' end as stratum from labels)"


def _strata(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "labels").withColumn("stratum", agreement.stratum(F.col("quality"), F.col("toxic"), F.col("quality")))


@register(f"select count(*) as n, round({_KAPPA_SQL}, 6) as kappa from labels")
def kappa_labels(spark, sf_dir):
    return agreement.report(_t(spark, sf_dir, "labels"), "quality", "toxic").select("n", _r("kappa"))


@register(f"""with {_STRATA_SQL}, g as (select *, unnest(['overall', case when quality <> toxic then 'disagreements' else 'agreements' end, stratum]) as group_name from strata),
        found as (select group_name, count(*) as n, count(*) filter (where quality = toxic) as n_agree, count(*) filter (where quality <> toxic) as n_disagree,
                         round(avg((quality = toxic)::int), 6) as agreement_rate, round({_KAPPA_SQL}, 6) as kappa from g group by 1)
        select group_name, coalesce(n, 0) as n, coalesce(n_agree, 0) as n_agree, coalesce(n_disagree, 0) as n_disagree, agreement_rate, kappa
        from (select unnest({list(agreement.GROUPS)}) as group_name) left join found using (group_name)""")
def agreement_report(spark, sf_dir):
    rows = agreement.grouped_report(_strata(spark, sf_dir), "quality", "toxic", F.col("quality") != F.col("toxic"))
    return rows.select("group_name", "n", "n_agree", "n_disagree", _r("agreement_rate"), _r("kappa"))


@register("""select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality <> 1 and toxic = 1) as fp, count(*) filter (where quality = 1 and toxic <> 1) as fn,
        count(*) filter (where quality <> 1 and toxic <> 1) as tn, round(avg((quality = 1)::int), 6) as truth_rate, round(avg((toxic = 1)::int), 6) as guess_rate from labels""")
def confusion_counts(spark, sf_dir):
    return agreement.confusion(_t(spark, sf_dir, "labels"), "quality", "toxic").select("tp", "fp", "fn", "tn", _r("truth_rate"), _r("guess_rate"))


@register(f"with {_STRATA_SQL} select stratum, count(*) as n from strata group by 1")
def stratum_counts(spark, sf_dir):
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


_SAMPLE_SQL = f"""{_STRATA_SQL}, q as (select least(60 // 2, count(*) filter (where stratum = 'disagree')) as d from strata),
    ranked as (select *, row_number() over (partition by stratum order by md5('13|' || doc_id::varchar), doc_id) as nth from strata),
    sampled as (select r.* from ranked r, q where nth <= case stratum when 'disagree' then d when 'agree_rel' then (60 - d) - (60 - d) // 2 else (60 - d) // 2 end)"""


@register(f"with {_SAMPLE_SQL} select doc_id, stratum from sampled")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(_strata(spark, sf_dir), ["doc_id"], 60, 13).select("doc_id", "stratum")


@register(f"""with {_SAMPLE_SQL}, acc as (select stratum, avg((quality = 1)::int) as accuracy from sampled group by 1), size as (select stratum, count(*) as n from strata group by 1)
    select round(sum(n * accuracy) / sum(n), 6) as weighted_accuracy, sum(n)::bigint as population from acc join size using (stratum)""")
def population_weighted_accuracy(spark, sf_dir):
    strata = _strata(spark, sf_dir)
    sample = sampling.stratified(strata, ["doc_id"], 60, 13).withColumn("correct", F.col("quality") == 1)
    return agreement.weighted_accuracy(sample, strata).select(_r("weighted_accuracy"), "population")


@register("""select doc_id, ordinal, ordinal % 3 as choice from (select doc_id, row_number() over (order by md5('42|' || doc_id::varchar), doc_id) - 1 as ordinal from documents where length(text) >= 200) where ordinal < 90""")
def eligible_round_robin(spark, sf_dir):
    docs = corpus.eligible(_t(spark, sf_dir, "documents"), "text", 200).select("doc_id")
    rows = sampling.round_robin(docs, "doc_id", 90, 42, 3)
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("choice").cast("long").alias("choice"))


_CAPPED = (40, 5, 3)  # rows, seed, most of a question


def _capped_sql() -> str:
    n, seed, most = _CAPPED
    rest = n - n // 2
    out = f"with {_STRATA_SQL}, placed as (select doc_id, doc_id % 25 as question, stratum, md5('{seed}|' || doc_id::varchar) as place from strata)"
    for k, (stratum, target) in enumerate((("disagree", n // 2), ("agree_rel", rest - rest // 2), ("agree_not", rest // 2))):
        before = " union all ".join(["select -1 as question where false", *[f"select question from took_{j}" for j in range(k)]])
        out += f""", used_{k} as (select question, count(*) as used from ({before}) group by 1), took_{k} as (
            select doc_id, question, stratum from (select p.*, row_number() over (partition by question order by place, doc_id) as nth from placed p where stratum = '{stratum}') left join used_{k} using (question)
            where nth <= {most} - coalesce(used, 0) order by place, doc_id limit {target})"""
    return out + ", capped as (" + " union all ".join(f"select * from took_{k}" for k in range(3)) + ")"


def _capped(spark, sf_dir) -> DataFrame:
    n, seed, most = _CAPPED
    rows = _strata(spark, sf_dir).select("doc_id", (F.col("doc_id") % 25).alias("question"), "stratum")
    return sampling.capped(rows, ["doc_id"], n, seed, most, "question")


@register(_capped_sql() + " select doc_id, question, stratum from capped")
def capped_sample(spark, sf_dir):
    return _capped(spark, sf_dir)


@register(_capped_sql() + " select count(distinct question) as questions, count(*) as rows from capped")
def questions_in_sample(spark, sf_dir):
    return sampling.questions_in(_capped(spark, sf_dir), "question")


@register("select doc_id, row_number() over (order by md5('9|' || doc_id::varchar), doc_id) as place from (select doc_id from documents order by md5('11|' || doc_id::varchar), doc_id limit 70)")
def shuffled_subsample(spark, sf_dir):
    rows = sampling.sample(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 70, 11)
    return sampling.shuffled(rows, ["doc_id"], 9).withColumn("place", F.col("place").cast("long"))


@register("""select event_id, coalesce(a, false) as judge_a, coalesce(b, false) as judge_b, case when coalesce(a, false) = coalesce(b, false) then coalesce(a, false) else coalesce(c, false) end as final
    from (select event_id, case when event_id % 7 > 0 then value > 50 end as a, case when event_id % 5 > 0 then user_id % 2 = 0 end as b, case when event_id % 3 > 0 then event_type = 'view' end as c from events)""")
def votes_with_nulls(spark, sf_dir):
    n = F.col("event_id")
    a, b, c = F.when(n % 7 > 0, F.col("value") > 50), F.when(n % 5 > 0, F.col("user_id") % 2 == 0), F.when(n % 3 > 0, F.col("event_type") == "view")
    return agreement.with_tiebreak(_t(spark, sf_dir, "events"), a, b, c).select("event_id", "judge_a", "judge_b", "final")


# --- text, corpus statistics, duplicates ---------------------------------------------------------


@register("select event_type as variant, round(avg(value), 6) as mean_ms, min(value) as min_ms, max(value) as max_ms from events group by 1")
def means_by_variant_latency(spark, sf_dir):
    rows = metrics.latency(_t(spark, sf_dir, "events"), "value", ("event_type",))
    return rows.select(F.col("event_type").alias("variant"), _r("mean_ms"), "min_ms", "max_ms")


_DELTA_SQL = _JUDGED_SQL + f""", gold as (select query_id, item_id from labelled where final), sizes as (select query_id, count(*) as n_gold from gold group by 1),
        h_base as (select * from hits where variant = 'baseline'), h_new as (select * from hits where variant = 'qr_only'),
        deltas as (select n.query_id, n.recall_at_10 - b.recall_at_10 as delta, length({_NEW_SQL.replace("text", "q.text")}) / greatest(length(q.text), 1) as ratio, q.text as original
            from ({_scores_sql("h_new")}) n join ({_scores_sql("h_base")}) b on b.query_id = n.query_id join benchmark q on q.item_id = n.query_id)"""
EXPANDED = 1.8  # rewrites that are so many times as long as the question count as expanded


def _rewrite_deltas(spark, sf_dir) -> DataFrame:
    """What rewriting does to the recall of each question."""
    hits = _variant_hits(spark, sf_dir)
    pool = workspace.materialize(pooling.pool(_source_items(spark, sf_dir), hits), "pool")
    docs = _content(spark, sf_dir).select("item_id", F.col("content").alias("body"))
    gold = _rule_judges(pool.join(docs, "item_id").join(_asked(spark, sf_dir).select("query_id", "question"), "query_id")).filter("final")
    scores = metrics.per_query(hits.filter(F.col("variant").isin("baseline", "qr_only")), workspace.materialize(gold.select("query_id", "item_id"), "gold"), keep_empty=False)
    deltas = metrics.deltas(workspace.materialize(scores, "scores"), "recall_at_10", "baseline")
    return metrics.with_rewrites(deltas, _asked(spark, sf_dir).withColumnRenamed("question", "original"))


@register(f"{_DELTA_SQL} select ratio >= {EXPANDED} as expanded, count(*) as n, round(avg(delta), 6) as mean_delta from deltas group by 1")
def bucketed_delta(spark, sf_dir):
    return metrics.by_expansion(_rewrite_deltas(spark, sf_dir), EXPANDED).select("expanded", "n", _r("mean_delta"))


@register(f"{_DELTA_SQL} select query_id, round(delta, 6) as delta, original, round(ratio, 6) as ratio from deltas where delta < -1e-9")
def lost_queries(spark, sf_dir):
    return metrics.ordered_changes(_rewrite_deltas(spark, sf_dir), "worse").select("query_id", _r("delta"), "original", _r("ratio"))


@register(f"{_DELTA_SQL} select query_id, round(delta, 6) as delta, original from deltas where delta > 1e-9 order by round(delta, 6) desc, query_id limit 8")
def most_gained_queries(spark, sf_dir):
    rounded = _rewrite_deltas(spark, sf_dir).withColumn("delta", F.round("delta", 6))
    return metrics.ordered_changes(rounded, "better", 8).select("query_id", "delta", "original")


_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


@register("""select count(n_chars) as n, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 6) as std, min(n_chars) as min, quantile_cont(n_chars, 0.25)::double as q25,
        quantile_cont(n_chars, 0.5)::double as q50, quantile_cont(n_chars, 0.75)::double as q75, max(n_chars) as max from documents""")
def describe_n_chars(spark, sf_dir):
    return corpus.described(_t(spark, sf_dir, "documents"), "n_chars").withColumn("mean", _r("mean")).withColumn("std", _r("std"))


@register("select " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) as p{round(100 * q)}" for q in _QUANTILES) + ", sum(round_even(n_chars / 1000, 0))::bigint as est_chunks from documents")
def quantiles_n_chars(spark, sf_dir):
    found = corpus.quantiles(_t(spark, sf_dir, "documents"), "n_chars", _QUANTILES)
    return found.select(*[_r(c) for c in found.columns if c != "est_chunks"], "est_chunks")


@register("""select count(*) as n, count(distinct source) as sources, count(distinct lang) as langs, count(text) as with_text, round(count(text) / count(*), 6) as text_share, count(*) - count(text) as without_text from documents""")
def corpus_summary(spark, sf_dir):
    return corpus.summary(_t(spark, sf_dir, "documents"), ["source", "lang"], "text").withColumn("text_share", _r("text_share"))


_SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TITLE_SQL = rf"regexp_replace(lower(regexp_replace(split_part(text, '.', 1), '^{_SPACE_SQL}+|{_SPACE_SQL}+$', '', 'g')), '^\d+(\.\d+)*\.?\s*', '')"


def _title():
    return F.split_part("text", F.lit("."), F.lit(1))


@register(f"select title, count(*) as n from (select {_TITLE_SQL} as title from documents) group by 1 order by n desc, title limit 30")
def title_normalise_counts(spark, sf_dir):
    return corpus.title_counts(_t(spark, sf_dir, "documents"), _title(), 30)


@register(f"""select candidate, count(*) filter (where starts_with(title, candidate)) as n, round(count(*) filter (where starts_with(title, candidate)) / count(*), 6) as share
    from (select {_TITLE_SQL} as title from documents), (values ('the'), ('of'), ('die'), ('la')) c(candidate) group by 1""")
def candidate_title_share(spark, sf_dir):
    return corpus.candidate_share(_t(spark, sf_dir, "documents"), _title(), ["the", "of", "die", "la"]).withColumn("share", _r("share"))


@register("""select (select doc_id from documents order by n_chars desc, doc_id limit 1) as longest, (select doc_id from documents order by n_chars, doc_id limit 1) as shortest""")
def longest_shortest_doc(spark, sf_dir):
    return corpus.extremes(_t(spark, sf_dir, "documents"), "doc_id", "n_chars")


@register("select lang, source, count(*) as n from documents group by 1, 2")
def counts_by_category(spark, sf_dir):
    return corpus.counts(_t(spark, sf_dir, "documents"), "lang", "source")


@register("select source as key, doc_id from documents qualify row_number() over (partition by source order by doc_id desc) = 1")
def dup_last_wins(spark, sf_dir):
    return corpus.one_per_key(_t(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source"), "doc_id", True).select("key", "row.doc_id")


@register("select source as key, doc_id from documents qualify row_number() over (partition by source order by doc_id) = 1")
def dup_first_wins(spark, sf_dir):
    return corpus.one_per_key(_t(spark, sf_dir, "documents").select("doc_id", "source"), F.col("source"), "doc_id", False).select("key", "row.doc_id")


_LINES_SQL = r"""list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(ltrim(trim(x), '0123456789.-) '))), lambda x: x <> '')"""


@register(f"select conv_id, turn, array_to_string({_LINES_SQL}[1:3], '|') as questions from conversations")
def hq_lines_parse(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.question_lines(F.col("text"), 3), "|").alias("questions"))


@register("""select conv_id, turn, coalesce(trim(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '"'), '') as question from conversations""")
def first_question_clean(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.first_question(F.col("text")).alias("question"))


@register(r"""select event_id, case event_id % 6 when 0 then regexp_extract(props, '-?\d+')::int <> 0 when 1 then regexp_extract(props, '-?\d+')::int <> 0 when 2 then starts_with(regexp_extract(props, '\d+'), '1')
        when 3 then false when 4 then starts_with(regexp_extract(props, '\d+'), '1') else false end as relevant from events""")
def label_parse(spark, sf_dir):
    """Answers in six forms: an object, one in prose, a word in capitals and a number, an object without the field, a number, nothing."""
    number = F.regexp_extract("props", r"-?\d+", 0)
    of = F.col("event_id") % 6
    answer = (
        F.when(of == 0, F.concat(F.lit('{"relevant": '), number, F.lit(', "why": "x"}'))).when(of == 1, F.concat(F.lit('Sure:\n{"relevant": "'), number, F.lit('"} I hope')))
        .when(of == 2, F.concat(F.lit("RELEVANT: "), number)).when(of == 3, F.lit('{"score": 1} relevant: 1')).when(of == 4, F.concat(F.lit("  "), number))
    )
    return _t(spark, sf_dir, "events").select("event_id", answer_labels.relevant_label(answer).alias("relevant"))


@register()
def pages_parse(spark, sf_dir):
    return html_pages.parse_pages(_t(spark, sf_dir, "pages"))
