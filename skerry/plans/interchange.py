"""Registered queries over sources, sinks, parsing and model calls, and their SQL.

Files are made from the given tables, written below the shared folder and read back, so every row of a
table goes through the format.  Models are fixed rules over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry import schemas, workspace
from skerry.functions import text as tx
from skerry.operators import agreement, models, ordering
from skerry.plans.catalogue import _t, register
from skerry.sources import articles, literature, tables

# --- markup -----------------------------------------------------------------------------------------

_CLEAN_SQL = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}]', ' ', 'g')"


def _clean(text: Column) -> Column:
    """Text without characters that markup can't hold or changes."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", " ")


def _marked(text: Column) -> Column:
    return F.replace(F.replace(F.replace(_clean(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _article_files(spark, sf_dir, whole: bool = False) -> DataFrame:
    """An article of each document; every 50th file is cut off, unless all are to be ``whole``."""
    text, number = _marked(F.col("text")), F.col("doc_id").cast("string")
    parts = [
        F.lit("<set><article><front><journal-meta><journal-title>"), _marked(F.col("source")), F.lit('</journal-title></journal-meta><article-meta><article-id pub-id-type="pmid"> '), number,
        F.lit('</article-id><article-id pub-id-type="pmc">PMC'), number, F.lit("</article-id><title-group><article-title>T <i>"), F.col("lang"),
        F.lit('</i></article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>S'), number, F.lit("</surname><given-names> "), F.col("lang"),
        F.lit('</given-names></name></contrib><contrib contrib-type="author"><name/></contrib></contrib-group><abstract><p>['), text,
        F.lit("]</p></abstract></article-meta></front><body>lost<sec><title>All</title><p>["), text, F.lit("]</p><fig>no</fig>tail</sec><sec><p>untitled</p></sec></body></article></set>"),
    ]
    full = F.concat(*parts)
    markup = full if whole else F.when(F.col("doc_id") % 50 == 7, F.left(full, F.length(full) - 5)).otherwise(full)
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(number, F.lit(".xml")).alias("path"), F.encode(markup, "UTF-8").alias("content"))


def _md5(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


@register(f"""select doc_id::varchar || '.xml' as path, doc_id % 50 <> 7 as parsed, if(doc_id % 50 = 7, null, doc_id::varchar) as pmid, if(doc_id % 50 = 7, null, doc_id::varchar) as pmcid,
        if(doc_id % 50 = 7, null, 'T ' || lang) as title, if(doc_id % 50 = 7, null, source) as journal, if(doc_id % 50 = 7, null, 'S' || doc_id::varchar || ', ' || lang) as authors,
        if(doc_id % 50 = 7, null, md5('Abstract:[' || {_CLEAN_SQL} || ']')) as abstract_md5, if(doc_id % 50 = 7, null, md5('All:[' || {_CLEAN_SQL} || ']tail')) as body_md5 from documents""")
def articles_parse(spark, sf_dir):
    rows = articles.parse_files(_article_files(spark, sf_dir))

    def sections(name: str) -> Column:
        return _md5(F.array_join(F.transform(name, lambda s: F.concat(s["title"], F.lit(":"), s["text"])), "|")).alias(f"{name}_md5")

    return rows.select("path", F.col("error").isNull().alias("parsed"), "pmid", "pmcid", "title", "journal", F.array_join("authors", ";").alias("authors"), sections("abstract"), sections("body"))


@register("select doc_id::varchar || '.xml' as path, doc_id % 50 <> 7 as parsed, if(doc_id % 50 = 7, null, doc_id::varchar) as pmcid from documents")
def bundles_split(spark, sf_dir):
    return articles.bundle_articles(_article_files(spark, sf_dir)).select("path", F.col("error").isNull().alias("parsed"), "pmcid")


@register(f"""select doc_id::varchar as pmcid, doc_id % 50 <> 7 as parsed, case when doc_id % 50 <> 7 then md5('All:[' || {_CLEAN_SQL} || ']tail') end as body_md5 from documents""")
def bundles_read(spark, sf_dir):
    """Bundles of some hundred documents each, with a root that declares a prefix; every 50th article has an end tag too many."""
    docs = _article_files(spark, sf_dir, whole=True)
    broken = F.when(F.col("doc_id") % 50 == 7, F.lit("</sec>")).otherwise(F.lit(""))
    inner = F.regexp_extract(F.decode("content", "UTF-8"), r"(?s)<article>(.*)</article>", 1)
    one = F.concat(F.lit("<article "), F.lit('id="a'), F.col("doc_id").cast("string"), F.lit('" x:k="1">'), broken, inner, F.lit("</article>"))
    bundle = F.floor(F.col("doc_id") / 300)
    rows = docs.select(bundle.alias("bundle"), F.lit(1).alias("part"), "doc_id", one.alias("value"))
    ends = docs.select(bundle.alias("bundle")).distinct().select("bundle", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), F.lit(0).cast("long").alias("doc_id"))
    ends = ends.withColumn("value", F.when(F.col("part") == 0, F.lit('<pmc-articleset xmlns:x="urn:x">')).otherwise(F.lit("</pmc-articleset>")))
    path = workspace.new_path(spark, "bundles")
    rows.unionByName(ends).repartition("bundle").sortWithinPartitions("bundle", "part", "doc_id").select("bundle", "value").write.partitionBy("bundle").text(path)
    found = workspace.materialize(articles.read_bundles(spark, f"{path}/bundle=*"), "articles")
    parsed = articles.parse_files(found.filter("error is null").select(F.col("pmcid").alias("path"), "content"))
    body = _md5(F.array_join(F.transform("body", lambda s: F.concat(s["title"], F.lit(":"), s["text"])), "|"))
    # Three plans read what is parsed: markup is parsed once.
    whole = workspace.materialize(parsed.select(F.col("path").alias("pmcid"), F.lit(True).alias("parsed"), body.alias("body_md5")), "bodies")
    # A broken article has no identifier; it is told by what the others leave over.
    rest = docs.select(F.col("doc_id").cast("string").alias("pmcid")).join(whole.select("pmcid"), "pmcid", "left_anti")
    if rest.count() != found.filter("error is not null").count():
        raise ValueError("articles are missing")
    return whole.unionByName(rest.select("pmcid", F.lit(False).alias("parsed"), F.lit(None).cast("string").alias("body_md5")))


def _citation_files(spark, sf_dir) -> DataFrame:
    """Files of 1,000 citations, one for each event: a user has several, with dates of six forms."""
    ts, form = F.col("ts"), F.col("event_id") % 6
    year = F.date_format(ts, "yyyy")
    date = (
        F.when(form == 0, F.concat(F.lit("<Year>"), year, F.lit("</Year><Month>"), F.date_format(ts, "MMM"), F.lit("</Month><Day>"), F.date_format(ts, "d"), F.lit("</Day>")))
        .when(form == 1, F.concat(F.lit("<Year> "), year, F.lit("</Year><Month>"), F.date_format(ts, "MM"), F.lit("</Month>"))).when(form == 2, F.concat(F.lit("<Year>"), year, F.lit("</Year>")))
        .when(form == 3, F.concat(F.lit("<MedlineDate>"), year, F.lit(" Jan-Feb</MedlineDate>"))).when(form == 4, F.lit("<MedlineDate>not a date</MedlineDate>"))
        .otherwise(F.concat(F.lit("<Year>"), year, F.lit("</Year><Month>"), F.date_format(ts, "MM"), F.lit("</Month><Day>31</Day>")))
    )
    one = F.concat(
        F.lit("<PubmedArticle><PMID>"), F.col("user_id").cast("string"), F.lit("</PMID><JournalIssue><PubDate>"), date, F.lit("</PubDate></JournalIssue><MeshHeading><DescriptorName> "),
        F.col("event_type"), F.lit("</DescriptorName></MeshHeading><MeshHeading><DescriptorName> </DescriptorName></MeshHeading></PubmedArticle>"),
    )
    rows = _t(spark, sf_dir, "events").select(F.lpad(F.floor(F.col("event_id") / 1000).cast("string"), 12, "0").alias("path"), F.struct("event_id", one.alias("markup")).alias("one"))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("one")), lambda x: x["markup"]), "").alias("body"))  # 1,000 in each
    return files.select("path", F.encode(F.concat(F.lit("<s>"), "body", F.lit("</s>")), "UTF-8").alias("content"))


_LAST_SQL = "last as (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1)"


@register(f"""with {_LAST_SQL} select user_id::varchar as pmid, event_type as mesh_terms, case event_id % 6 when 0 then ts::date when 1 then date_trunc('month', ts)::date when 4 then null
        when 5 then if(day(last_day(ts::date)) = 31, last_day(ts::date), date_trunc('year', ts)::date) else date_trunc('year', ts)::date end as published_at from last where user_id % 3 > 0""")
def citations_join(spark, sf_dir):
    known = _t(spark, sf_dir, "events").filter(F.col("user_id") % 3 > 0).select(F.col("user_id").cast("string").alias("pmid")).distinct()
    none = F.lit(None).cast("string")
    parsed = known.select("pmid", none.alias("doi"), F.lit("t").alias("title"), none.alias("journal"), F.array().cast("array<string>").alias("authors"))
    rows = articles.enriched(articles.papers(parsed), articles.read_citations(_citation_files(spark, sf_dir)))
    return rows.select("pmid", F.array_join("mesh_terms", ";").alias("mesh_terms"), "published_at")


@register("select distinct user_id::varchar as pmid from events where user_id % 3 = 0")
def citations_unknown(spark, sf_dir):
    known = _t(spark, sf_dir, "events").filter(F.col("user_id") % 3 > 0).select(F.col("user_id").cast("string").alias("pmid")).distinct()
    return articles.unknown_citations(known, articles.read_citations(_citation_files(spark, sf_dir)))


# --- lay questions ----------------------------------------------------------------------------------


def _lay_file(spark, sf_dir) -> str:
    """One JSON document: each benchmark text asks for two articles, which it shares with its neighbours."""

    def inner(column: Column) -> Column:
        written = F.to_json(F.struct(column))
        return F.substring(written, F.lit(2), F.length(written) - 2)

    def article(k: int) -> Column:
        pmid, texts = (F.col("item_id") + 1000 + k).cast("string"), F.struct(F.col("text").alias("2"), F.lit("end.").alias("1"))
        return F.concat(F.lit('"'), pmid, F.lit('": '), F.to_json(F.struct(F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("Title"), texts.alias("abstract"))))

    entry = F.concat(F.lit('"'), F.col("item_id").cast("string"), F.lit('": {'), inner(F.col("text").alias("question")), F.lit(', "question_type": "A", '), article(0), F.lit(", "), article(1), F.lit("}"))
    rows = _t(spark, sf_dir, "benchmark").withColumn("text", F.coalesce("text", F.lit(""))).select(F.struct("item_id", entry.alias("e")).alias("r"))
    whole = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["e"]), ",\n").alias("body"))  # the format is one document
    path = workspace.new_path(spark, "lay")
    whole.select(F.concat(F.lit("{"), "body", F.lit("}"))).coalesce(1).write.text(path)
    return path


_LAY_SQL = "lay as (select item_id, item_id + 1000 + k as pmid, coalesce(text, '') as text, k from benchmark, (values (0), (1)) v(k))"


@register(f"with {_LAY_SQL} select pmid::varchar as pmid, 't' || item_id::varchar as title, md5(text || ' end.') as text_md5 from lay qualify row_number() over (partition by pmid order by item_id, k) = 1")
def lay_articles(spark, sf_dir):
    found, _ = tables.read_lay_questions(spark, _lay_file(spark, sf_dir))
    return found.select("pmid", "title", _md5(F.get("sections", F.lit(0))["text"]).alias("text_md5"))


@register(f"with {_LAY_SQL} select item_id::varchar as qid, text as question, string_agg(pmid::varchar, ',' order by k) as gold_pmids from lay group by 1, 2")
def lay_queries(spark, sf_dir):
    _, asked = tables.read_lay_questions(spark, _lay_file(spark, sf_dir))
    return asked.select("qid", "question", F.array_join("gold_pmids", ",").alias("gold_pmids"))


@register(f"with {_LAY_SQL}, few as (select item_id from benchmark order by item_id limit 5) select distinct pmid::varchar as pmid from lay where item_id in (select item_id from few)")
def lay_first_queries(spark, sf_dir):
    return tables.first_queries(*tables.read_lay_questions(spark, _lay_file(spark, sf_dir)), 5)[0].select("pmid")


# --- sheets and label files -------------------------------------------------------------------------

_VALUE_SQL = "case doc_id % 4 when 0 then 1 when 1 then 0 end"


def _judge_labels(spark, sf_dir) -> DataFrame:
    chunk = F.concat(F.col("doc_id").cast("string"), F.lit(":0000"))
    qa = F.concat(F.lit("q"), F.floor(F.col("doc_id") / 10).cast("string"))  # ten documents each, at any size
    return _t(spark, sf_dir, "labels").select(qa.alias("qa_id"), chunk.alias("chunk_id"), F.col("quality").alias("judge_a"), F.col("toxic").alias("judge_b"), F.col("quality").alias("final"), "doc_id")


def _sheet(spark, sf_dir, numbered: bool) -> DataFrame:
    questions = _t(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qa_id"), F.col("text").alias("question"))
    chunks = _t(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(":0000")).alias("chunk_id"), F.col("text").alias("content"))
    return tables.blind_sheet(_judge_labels(spark, sf_dir), questions, chunks, numbered)


@register("""select 'q' || (l.doc_id // 10)::varchar as qa_id, l.doc_id::varchar || ':0000' as chunk_id, coalesce(b.text, '') as question, md5(coalesce(d.text, '')) as chunk_md5, '' as human_relevant
    from labels l left join benchmark b on b.item_id = l.doc_id // 10 left join documents d using (doc_id)""")
def blind_sheet(spark, sf_dir):
    return _sheet(spark, sf_dir, False).select("qa_id", "chunk_id", "question", _md5(F.col("chunk_text")).alias("chunk_md5"), "human_relevant")


@register(f"""with rows as (select quality as judge_a, toxic as judge_b, quality as final, {_VALUE_SQL} as value from labels where doc_id % 4 < 2),
        g as (select *, unnest(['overall', case when judge_a <> judge_b then 'disagreements' else 'agreements' end, case when judge_a <> judge_b then 'disagree' when final = 1 then 'agree_rel' else 'agree_not' end]) as group_name from rows),
        found as (select group_name, count(*) as n, round(avg((value = final)::int), 6) as accuracy, avg(value) as pa, avg(final) as pb, avg((value = final)::int) as po from g group by 1)
        select group_name, coalesce(n, 0) as n, accuracy, round(case when pa * pb + (1 - pa) * (1 - pb) >= 1 then 1.0 else (po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0) end, 6) + 0.0 as kappa
        from (select unnest({list(agreement.GROUPS)}) as group_name) left join found using (group_name)""")
def sheet_validation(spark, sf_dir):
    """A numbered sheet is written with a byte-order mark, filled in, read, joined with the labels and reported by group."""
    number = F.regexp_extract("chunk_id", "^[0-9]+", 0).cast("long") % 4
    filled = _sheet(spark, sf_dir, True).withColumn("relevant", F.when(number == 0, F.lit("1")).when(number == 1, F.lit(" 0 ")).when(number == 2, F.lit("x")))
    path = workspace.new_path(spark, "sheet")
    tables.write_sheet(filled, path, mark=True)
    rows = agreement.validation(agreement.scored_sheet(tables.read_labels_csv(spark, path, "relevant"), _judge_labels(spark, sf_dir)))
    return rows.select("group_name", "n", F.round("accuracy", 6).alias("accuracy"), (F.round("kappa", 6) + 0.0).alias("kappa"))  # no negative zero


@register("select 'q' || (doc_id // 10)::varchar as qa_id, doc_id::varchar || ':0000' as chunk_id, quality as judge_a, toxic as judge_b, quality as final from labels")
def labels_jsonl(spark, sf_dir):
    path = workspace.new_path(spark, "labels")
    _gold_files(spark, sf_dir, path)
    return tables.read_jsonl(spark, f"{path}/labels", schemas.JUDGE_LABEL)


def _gold_files(spark, sf_dir, path: str) -> None:
    rows = _judge_labels(spark, sf_dir).withColumns({c: F.col(c) == 1 for c in ("judge_a", "judge_b", "final")})
    labelled = rows.select("qa_id", "chunk_id", "judge_a", "judge_b", "final", F.col("qa_id").alias("query_id"), F.col("doc_id").alias("pos"), F.col("chunk_id").alias("item_id"))
    tables.write_gold(labelled, agreement.report(labelled, "judge_a", "judge_b"), path)


@register("select 'q' || (doc_id // 10)::varchar as query_id, coalesce(string_agg(doc_id::varchar || ':0000', ',' order by doc_id) filter (where quality = 1), '') as relevant_ids from labels group by 1")
def gold_files(spark, sf_dir):
    path = workspace.new_path(spark, "gold")
    _gold_files(spark, sf_dir, path)
    return tables.read_jsonl(spark, f"{path}/gold", "query_id string, relevant_ids array<string>").select("query_id", F.array_join("relevant_ids", ",").alias("relevant_ids"))


@register("select 'qa_' || lpad(item_id::varchar, 4, '0') as qa_id, (1000 + item_id)::varchar as pmid, text as question, 'direct' as prompting_strategy, item_id::varchar as relevant from benchmark")
def questions_jsonl(spark, sf_dir):
    qa = F.concat(F.lit("qa_"), F.lpad(F.col("item_id").cast("string"), 4, "0"))
    number = F.col("item_id").cast("string")
    rows = _t(spark, sf_dir, "benchmark").select(qa.alias("qa_id"), (F.col("item_id") + 1000).cast("string").alias("pmid"), F.col("text").alias("question"), F.lit("direct").alias("prompting_strategy"), F.array(number).alias("relevant_chunk_ids"))
    path = workspace.new_path(spark, "questions")
    tables.write_questions(rows, path)
    back = tables.read_jsonl(spark, path, schemas.QA_PAIR)
    return back.select("qa_id", "pmid", "question", "prompting_strategy", F.array_join("relevant_chunk_ids", ",").alias("relevant"))


# --- runs, dumps, collections -----------------------------------------------------------------------

_RANKED_SQL = "(select user_id::varchar as query_id, event_type as variant, row_number() over (partition by user_id, event_type order by value desc, event_id) as rank, event_id::varchar as item_id from events)"


def _ranked(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("variant"), F.row_number().over(order).alias("rank"), F.col("event_id").cast("string").alias("item_id"))
    return rows.filter("rank <= 10")


@register(f"select * from {_RANKED_SQL} where rank <= 10")
def ranked_json(spark, sf_dir):
    path = workspace.new_path(spark, "ranked")
    tables.write_ranked_json(_ranked(spark, sf_dir), path)
    return tables.read_ranked_json(spark, path, lines=True).withColumn("rank", F.col("rank").cast("long"))


@register(f"select 'large' as run, variant, query_id, count(*) as n from {_RANKED_SQL} where rank <= 10 group by all")
def results_by_tag(spark, sf_dir):
    path = workspace.new_path(spark, "results")
    tables.write_results(_ranked(spark, sf_dir), path, "large")
    return spark.read.json(path).groupBy("run", "variant", F.col("query_id").cast("string").alias("query_id")).agg(F.count(F.lit(1)).alias("n"))


@register("select doc_id::varchar as pmid, source as journal, if(text is null, 0, 1)::int as n_abstract_sections, 2::int as n_body_sections, length(coalesce(text, ''))::int as abstract_chars, length(lang)::int + 1 as body_chars from documents")
def article_statistics(spark, sf_dir):
    section = F.struct(F.lit("Abstract").alias("title"), F.col("text").alias("text"))
    body = F.array(F.struct(F.lit("A").alias("title"), F.col("lang").alias("text")), F.struct(F.lit("B").alias("title"), F.lit("x").alias("text")))
    none = F.lit(None).cast("string")
    rows = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("pmid"), none.alias("pmcid"), none.alias("doi"), F.lit("t").alias("title"), F.col("source").alias("journal"), F.array().cast("array<string>").alias("authors"),
        F.when(F.col("text").isNotNull(), F.array(section)).otherwise(F.array().cast(f"array<{schemas.SECTION}>")).alias("abstract"), body.alias("body"),
    )
    path = workspace.new_path(spark, "articles")
    tables.write_articles(rows, path)
    return tables.read_article_statistics(spark, path).drop("title")


@register("select n_sections, count(*) as articles, round_even(count(*) / sum(count(*)) over (), 2) as share from (select least(doc_id % 3, 2)::int as n_sections from documents) group by 1")
def section_histogram(spark, sf_dir):
    sections = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: k < F.col("doc_id") % 3), lambda k: F.struct(k.cast("string").alias("title"), F.lit("x").alias("text")))
    return tables.section_histogram(_t(spark, sf_dir, "documents").select(sections.alias("abstract")))


@register("select doc_id::varchar || ':0000' as chunk_id, md5(coalesce(text, '')) as content_md5, lang || '?|' || source as questions from documents")
def enrichment_dump(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(":0000")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), F.array(F.concat("lang", F.lit("?")), "source").alias("hq_questions"))
    path = workspace.new_path(spark, "enrichment")
    tables.write_enrichment(rows, path)
    back = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<content:string,hq_questions:array<string>>>")).alias("chunk_id", "e"))
    return back.select("chunk_id", _md5(F.col("e.content")).alias("content_md5"), F.array_join("e.hq_questions", "|").alias("questions"))


@register("select item_id::varchar as qa_id, text as original, reverse(text) as rewritten from benchmark")
def rewrites_dump(spark, sf_dir):
    rows = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qa_id"), F.col("text").alias("question"), F.reverse("text").alias("rewritten"))
    path = workspace.new_path(spark, "rewrites")
    tables.write_rewrites(rows, path)
    back = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<original:string,rewritten:string>>")).alias("qa_id", "e"))
    return back.select("qa_id", "e.original", "e.rewritten")


@register("select distinct source as value from documents where source is not null")
def id_list(spark, sf_dir):
    path = workspace.new_path(spark, "ids")
    tables.write_ids(_t(spark, sf_dir, "documents"), "source", path)
    return spark.read.text(path)


def _collection(spark, sf_dir) -> tuple[tables.Collection, DataFrame]:
    """A collection that has rows put in twice, some of them in one upsert, others deleted, and buckets compacted in between."""
    store = tables.Collection(spark, workspace.new_path(spark, "collection"), 64, "vec_id")
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    store.write(rows)
    store.reset()
    store.write(rows.filter("vec_id % 3 > 0"))
    twice = F.explode(F.array(F.lit(100), F.lit(200), F.lit(300)))  # of a key's three rows the last counts
    even = rows.filter("vec_id % 2 = 0").select("vec_id", "embedding", "label", twice.alias("more")).select("vec_id", "embedding", (F.col("label") + F.col("more")).alias("label"), "more")
    store.upsert(even, order=F.col("more"))
    return store, rows


_UPSERT_SQL = "select vec_id, case when vec_id % 2 = 0 then label + 300 else label end as label from embeddings where vec_id % 3 > 0 or vec_id % 2 = 0"


@register(_UPSERT_SQL)
def collection_upsert(spark, sf_dir):
    return _collection(spark, sf_dir)[0].rows().select("vec_id", "label")


@register(f"""with upserted as ({_UPSERT_SQL})
        select 'snapshot' as version, vec_id, label from upserted union all
        select 'last', vec_id, label from upserted where vec_id % 5 > 0 and vec_id % 7 > 0 union all select 'last', vec_id, label + 1000 from embeddings where vec_id % 7 = 0""")
def collection_versions(spark, sf_dir):
    """After a snapshot rows are deleted, buckets compacted and rows put in; the snapshot stays as it was."""
    store, rows = _collection(spark, sf_dir)
    snapshot = store.rows()
    store.delete(rows.filter("vec_id % 5 = 0").select("vec_id"))
    store.compact(share=0.0)
    store.upsert(rows.filter("vec_id % 7 = 0").withColumn("label", F.col("label") + 1000))
    one, other = (v.select(F.lit(name).alias("version"), "vec_id", "label") for name, v in (("snapshot", snapshot), ("last", store.rows())))
    return one.unionByName(other)


# --- model calls and fetches ------------------------------------------------------------------------


@register("select item_id::varchar as qa_id, text as question, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as rewritten, (2 * length(text) + 6)::int as tokens from benchmark")
def model_rewrites(spark, sf_dir):
    rows = _t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qa_id"), F.col("text").alias("question"))
    return models.rewrite(rows, "Q: {query}", workspace.new_path(spark, "cache"), "echo", lambda system, user: (f" {user[3:]}\n", len(user), len(user)), models.Calls(threads=4))


@register("""select doc_id::varchar as chunk_id, md5('Ask 2 of ' || coalesce(text, '')) as prompt_md5, 2 * length(coalesce(text, '')) + 18 as total_tokens, 'A?|B?' as questions, md5(coalesce(text, '') || chr(10) || 'A?' || chr(10) || 'B?') as enriched_md5
    from documents order by doc_id::varchar offset 7 limit 1""")
def model_inspection(spark, sf_dir):
    """The eighth chunk in the order of identifiers."""
    chunks = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))
    row = models.inspected(chunks, 7, "Ask {n} of {content}", workspace.new_path(spark, "cache"), "template", lambda system, user: ("1. A?\n2. B?", len(user), len(user)), k=2)
    return row.select("chunk_id", _md5(F.col("prompt")).alias("prompt_md5"), F.col("total_tokens").cast("long").alias("total_tokens"), F.array_join("questions", "|").alias("questions"), _md5(F.col("enriched")).alias("enriched_md5"))


@register("""select chunk_id, 'What is ' || lang || '?' || chr(10) || 'Why ' || source || '?' as questions, md5(content || chr(10) || 'What is ' || lang || '?' || chr(10) || 'Why ' || source || '?') as enriched_md5
    from (select doc_id::varchar as chunk_id, lang, source, lang || '/' || source || '/' || coalesce(text, '') as content from documents)""")
def model_enrichment(spark, sf_dir):
    def call(system: str, user: str) -> tuple[str, int, int]:
        lang, source, _ = user.split("/", 2)
        return f"1. What is {lang}?\n\n2) Why {source}?\n3. one too many", 1, 1

    chunks = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat_ws("/", "lang", "source", F.coalesce("text", F.lit(""))).alias("content"), F.array().cast("array<string>").alias("hq_questions"))
    rows = models.enrich(chunks, "{content}", workspace.new_path(spark, "cache"), "template", call, k=2)
    return rows.select("chunk_id", F.array_join(tx.question_lines(F.substring("enriched", F.length("content") + 1, F.length("enriched")), 2), "\n").alias("questions"), _md5(F.col("enriched")).alias("enriched_md5"))


@register("""select 'qa_' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end as qa_id, doc_id::varchar as pmid, ['direct', 'conversational', 'clinical'][n % 3 + 1] || ' ' || length(coalesce(text, ''))::varchar as question,
        ['direct', 'conversational', 'clinical'][n % 3 + 1] as prompting_strategy from (select *, row_number() over (order by doc_id) - 1 as n from documents)""")
def model_questions(spark, sf_dir):
    strategy = F.element_at(F.array(*[F.lit(s) for s in schemas.STRATEGIES]), (F.col("ordinal") % 3 + 1).cast("int"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.join(ordering.numbered(docs.select("doc_id"), ["doc_id"], "ordinal"), "doc_id").select(F.col("doc_id").cast("string").alias("pmid"), "ordinal", strategy.alias("strategy"), F.col("text").alias("abstract"))
    templates = {s: f"{s}|{{abstract}}" for s in schemas.STRATEGIES}

    def call(system: str, user: str) -> tuple[str, int, int]:
        name, _, text = user.partition("|")
        return f'\n "{name} {len(text)}" \nmore', 1, 1

    return models.generate_questions(rows, templates, workspace.new_path(spark, "cache"), "template", call)


@register("""select doc_id, n % 2 = 0 as judge_a, n % 3 = 0 as judge_b, case when (n % 2 = 0) = (n % 3 = 0) then n % 2 = 0 else n % 5 < 2 end as final
    from (select doc_id, length(coalesce(text, '')) as n from documents)""")
def model_judges(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.lit("q").alias("question"), F.col("text").alias("content"))
    calls = tuple(lambda system, user, rule=rule: ('{"relevant": %d}' % rule(len(user) - 2), 1, 1) for rule in (lambda n: n % 2 == 0, lambda n: n % 3 == 0, lambda n: n % 5 < 2))
    return models.judge_twice(rows, "{question} {chunk}", workspace.new_path(spark, "cache"), ("A", "B", "C"), calls).select("doc_id", "judge_a", "judge_b", "final")


@register("select doc_id, length(coalesce(text, ''))::double as chars, (doc_id % 2)::double as odd, 2 as dimensions from documents")
def model_embeddings(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.concat((F.col("doc_id") % 2).cast("string"), F.coalesce("text", F.lit(""))).alias("t"))
    call = lambda texts: [[float(len(t) - 1), float(t[:1] == "1")] for t in texts]
    found = models.embed(rows, "t", workspace.new_path(spark, "cache"), "length", call, models.Calls(threads=2))
    return found.withColumn("dimensions", F.lit(models.probe(call))).select("doc_id", "dimensions", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("odd"))


@register("select doc_id::varchar as pmcid, md5(doc_id::varchar) as content_md5, doc_id % 2 = 0 as cached from documents where doc_id % 7 > 0")
def fetched_records(spark, sf_dir):
    """Every second record is in the cache already; some the service doesn't have."""
    cache = workspace.new_path(spark, "records")
    ids = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pmcid"))

    def fetch(numbers: list[str]) -> dict[str, bytes]:
        return {n: n.encode() for n in numbers if int(n) % 7}

    literature.fetched(ids.filter(F.col("pmcid").cast("long") % 2 == 0), cache, fetch)
    return literature.fetched(ids, cache, fetch).select("pmcid", F.md5("content").alias("content_md5"), "cached")


@register("""select doc_id, source || ', ' || lang as author, case when doc_id % 2 = 0 then doc_id::varchar end as pmcid, lang || chr(10) || source as abstract, 'sources: ' || source || ' {' || lang || '}' as prompt,
        round(length(source) / greatest(length(lang), 1), 6) as ratio, round_even(doc_id / 8, 2) as share from documents""")
def text_functions(spark, sf_dir):
    sections = F.array(F.struct(F.col("lang").alias("text")), F.struct(F.concat("source", F.lit("  \n")).alias("text")))
    number = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" PMC"), F.col("doc_id").cast("string"), F.lit("\n"))).when(F.col("doc_id") % 4 == 1, F.lit(" PMC "))
    return _t(spark, sf_dir, "documents").select(
        "doc_id", tx.author_name(F.concat(F.lit(" "), "source"), F.col("lang")).alias("author"), tx.optional_id(number).alias("pmcid"), tx.abstract_text(sections).alias("abstract"),
        tx.rendered("sources: {s} {{{l}}}", s=F.col("source"), l=F.col("lang")).alias("prompt"), F.round(tx.length_ratio(F.col("source"), F.col("lang")), 6).alias("ratio"), F.bround(F.col("doc_id") / 8, 2).alias("share"),
    )
