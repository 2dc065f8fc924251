import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from skerry.config import Settings
from skerry.functions import labels
from skerry.functions import text as tx
from skerry.operators import agreement, chunking, metrics, models, pooling, sampling, statistics, vector_search
from skerry.plans import experiment
from skerry.sources import articles, pages, tables
from skerry.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def score(spark, retrieved, relevant, **options):
    hits = spark.createDataFrame([("v", 1, i + 1, x) for i, x in enumerate(retrieved)], "variant string, query_id long, rank int, item_id string")
    gold = spark.createDataFrame([(1, x) for x in relevant], "query_id long, item_id string")
    return metrics.per_query(hits, gold, **options).first()


def test_recall_and_reciprocal_rank(spark):
    row = score(spark, "abcde", "bdz", recall_at=(3, 5))
    assert row["recall_at_3"] == pytest.approx(1 / 3) and row["recall_at_5"] == pytest.approx(2 / 3) and row["mrr"] == 0.5
    row = score(spark, "abc", "")
    assert row["recall_at_5"] == row["mrr"] == row["ndcg_at_10"] == 0
    assert score(spark, "abc", "c")["mrr"] == pytest.approx(1 / 3) and score(spark, "abc", "z")["mrr"] == 0


def test_ndcg(spark):
    assert score(spark, "abc", "ac", ndcg_at=3)["ndcg_at_3"] == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert score(spark, "abcde", "abcde", ndcg_at=2)["ndcg_at_2"] == pytest.approx(1)


@pytest.mark.parametrize("length, spans", [(0, []), (10, [(0, 10)]), (1000, [(0, 1000)]), (1001, [(0, 1000), (800, 1001)]), (2500, [(0, 1000), (800, 1800), (1600, 2500)])])
def test_windows(spark, length, spans):
    docs = spark.createDataFrame([(7, "é" * length)], "doc_id long, text string")
    rows = chunking.chunk(chunking.document_sections(docs)).orderBy("position").collect()
    assert [(r["char_start"], r["char_end"]) for r in rows] == spans
    assert [r["chunk_id"] for r in rows] == [f"7:{k:04d}" for k in range(len(spans))]


@pytest.mark.parametrize("size, overlap", [(10, 10), (10, -1), (0, 0)])
def test_windows_refuse(size, overlap):
    with pytest.raises(ValueError):
        chunking.windows(F.lit(1), size, overlap)


def test_sections_keep_apart(spark):
    rows = spark.createDataFrame([("1", [("A", "x" * 1200), (None, "y" * 500), ("C", "")])], "pmid string, sections array<struct<title:string,text:string>>")
    got = chunking.chunk(rows).orderBy("position").collect()
    assert [(r["section"], r["position"]) for r in got] == [("A", 0), ("A", 1), (None, 2)]


def test_text(spark):
    assert one(spark, tx.question_lines(F.lit("1. What is aspirin?\n2. Does it help?\n\n3. extra\n4. four"), 3)) == ["What is aspirin?", "Does it help?", "extra"]
    assert one(spark, tx.enriched_text(F.lit("c"), F.array(F.lit("q1"), F.lit("q2")))) == "c\nq1\nq2"
    assert one(spark, tx.first_question(F.lit('\n "What does aspirin do?"\nmore'))) == "What does aspirin do?"
    assert one(spark, tx.author_name(F.lit("Doe"), F.lit("John Q."))) == "Doe, John Q." and one(spark, tx.author_name(F.lit("Doe"), F.lit(None))) == "Doe"
    assert one(spark, tx.rendered("a {x} {{b}}", x=F.lit("1"))) == "a 1 {b}"
    import uuid

    assert one(spark, tx.uuid5(str(uuid.NAMESPACE_DNS), F.lit("é:0001"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "é:0001"))


@pytest.mark.parametrize("parts, date", [
    (("2023", "Jan", "15", None), "2023-01-15"), (("2024", "3", None, None), "2024-03-01"), (("2025", None, None, None), "2025-01-01"),
    ((None, None, None, "2023 Jan-Feb"), "2023-01-01"), ((None, None, None, "not a date"), None), (("2023", "Feb", "30", None), "2023-01-01"), ((None, "1", "1", None), None),
])
def test_partial_date(spark, parts, date):
    got = one(spark, tx.partial_date(*[F.lit(p).cast("string") for p in parts]))
    assert (str(got) if got else None) == date


@pytest.mark.parametrize("answer, value", [
    ('{"relevant": 1, "why": "x"}', True), ('{"relevant": 0}', False), ("relevant: 1", True), ("cannot tell", False), ('{"relevant": 0} {"relevant": 1}', True),
    ('{"relevant": true}', True), ('{"relevant": "1"}', True), ('{"relevant": 0.5}', False), ('{"relevant": null}', False), ("1", True), (None, False),
    ("Relevant: 1", True), ("RELEVANT 1", True), ('{"score": 1} relevant: 1', False), ('{"score": 1}', False), ('{"relevant": Infinity}', False), ('{"relevant": NaN}', False), ('{"relevant": [1]}', True), ("}{ 1", False), ("\n1", True),
])
def test_labels(answer, value):
    assert labels.relevant(answer) is value


def test_pool(spark):
    source = spark.createDataFrame([("q", 0, "c5"), ("q", 1, "c3")], "query_id string, pos int, item_id string")
    hits = spark.createDataFrame([("q", 1, "c3"), ("q", 2, "c9"), ("q", 1, "c9"), ("q", 2, "c1"), ("q", 3, "c0")], "query_id string, rank int, item_id string")
    assert [r["item_id"] for r in pooling.pool(source, hits, 2).orderBy("pos").collect()] == ["c5", "c3", "c1", "c9"]
    with pytest.raises(ValueError):
        pooling.require_known(hits, source)


def test_kappa(spark):
    def of(rows):
        return agreement.report(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()["kappa"]

    sheet = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 0), ("r", "c1", 1), ("r", "gone", 1)], "qa_id string, chunk_id string, value int")
    labels_ = spark.createDataFrame([("q", "c1", 1, 1, 1), ("q", "c2", 1, 1, 1), ("r", "c1", 0, 0, 0), ("r", "c9", 1, 0, 1)], "qa_id string, chunk_id string, judge_a int, judge_b int, final int")
    found = {r["group_name"]: (r["n"], r["accuracy"], r["kappa"]) for r in agreement.validation(agreement.scored_sheet(sheet, labels_)).collect()}
    third = pytest.approx(1 / 3)
    assert found["overall"] == found["agreements"] and found["overall"][:2] == (3, third) and found["disagreements"] == found["disagree"] == (0, None, None)
    assert found["agree_rel"][:2] == (2, 0.5) and found["agree_not"][:2] == (1, 0.0) and set(found) == set(agreement.GROUPS)
    votes = agreement.with_tiebreak(spark.createDataFrame([(1, True, None), (2, None, None), (3, True, False)], "k int, a boolean, b boolean"), F.col("a"), F.col("b"), F.col("k") == 3)
    assert {r["k"]: r["final"] for r in votes.collect()} == {1: False, 2: False, 3: True}

    assert of([(1, 1), (0, 0)]) == 1 and of([(1, 1), (1, 1)]) == 1 and of([]) == 0


def test_tiebreak_and_gold(spark):
    rows = spark.createDataFrame([("q", 0, "c1"), ("q", 1, "c2")], "query_id string, pos int, item_id string")
    judged = agreement.with_tiebreak(rows, F.lit(True), F.lit(False), F.col("item_id") == "c1")
    assert agreement.gold_lists(judged).first()["relevant_ids"] == ["c1"]
    asked = spark.createDataFrame([("q",), ("r",)], "query_id string")
    assert {r["query_id"]: r["gold_size"] for r in agreement.gold_sizes(asked, judged).collect()} == {"q": 1, "r": 0}


def pairs(spark, x, y):
    return spark.createDataFrame([("a", "b", "m", i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "a string, b string, metric string, query_id int, x double, y double")


def test_paired_tests(spark):
    assert tuple(statistics.wilcoxon(pairs(spark, [1, 2], [1, 2])).first()[k] for k in ("statistic", "p_value")) == (0.0, 1.0)
    assert tuple(statistics.wilcoxon(pairs(spark, [1], [2])).first()[k] for k in ("statistic", "p_value")) == (0.0, 1.0)
    x, y = [k / 10 + 0.05 * (k % 3) for k in range(12)], [k / 10 - 0.1 for k in range(12)]
    assert statistics.wilcoxon(pairs(spark, x, y)).first()["p_value"] < 0.05
    # t with 2 degrees of freedom has the closed form p = 1 - t / sqrt(t * t + 2).
    t = 1.7
    assert statistics.student_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(t * t + 2), abs=1e-12)
    assert statistics.student_two_sided(t, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi, abs=1e-12)


def test_ablation_has_twelve_comparisons(spark):
    names = ["baseline", "qr_only", "hq_only", "both"]
    rows = [(v, q, 0.1 * q + 0.01 * i, 0.05 * q) for i, v in enumerate(names) for q in range(12)]
    got = statistics.ablation(spark.createDataFrame(rows, "variant string, query_id int, recall_at_10 double, ndcg_at_10 double"), names)
    assert got.count() == 12


def test_collapse(spark):
    hits = spark.createDataFrame([("v", 1, r + 1, x) for r, x in enumerate(["111:0000", "111:0001", "222:0000", "111:0002"])], "variant string, query_id int, rank int, item_id string")
    got = metrics.collapsed(hits, F.substring_index("item_id", ":", 1)).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == ["111", "222"]


def test_samples(spark):
    rows = spark.range(12).withColumnRenamed("id", "k")
    got = sampling.round_robin(rows, "k", 9, 1, 3).orderBy("ordinal").collect()
    assert [r["choice"] for r in got] == [0, 1, 2] * 3 and got == sampling.round_robin(rows, "k", 9, 1, 3).orderBy("ordinal").collect()
    strata = spark.createDataFrame([(i, "disagree" if i < 2 else "agree_rel" if i < 20 else "agree_not") for i in range(40)], "k int, stratum string")
    counts = {r["stratum"]: r["count"] for r in sampling.stratified(strata, ["k"], 11, 3).groupBy("stratum").count().collect()}
    assert counts == {"disagree": 2, "agree_rel": 5, "agree_not": 4}


def test_capped_sample(spark):
    """As the greedy walk through the strata in hash order."""
    import hashlib
    import random

    rng = random.Random(4)
    data = [(i, f"q{rng.choice([0, 0, 0, 1, 2, 3, 4])}", rng.choice(["disagree", "agree_rel", "agree_not"])) for i in range(120)]
    for n, most in ((20, 3), (31, 9), (200, 2), (1, 1), (0, 5)):
        used, want = {}, []
        for stratum, target in (("disagree", n // 2), ("agree_rel", (n - n // 2 + 1) // 2), ("agree_not", (n - n // 2) // 2)):
            open_rows = sorted((hashlib.md5(f"6|{i}".encode()).hexdigest(), i, q) for i, q, s in data if s == stratum)
            for _, i, q in open_rows:
                if target and used.get(q, 0) < most:
                    used[q], target = used.get(q, 0) + 1, target - 1
                    want.append(i)
        got = sampling.capped(spark.createDataFrame(data, "k int, qa_id string, stratum string"), ["k"], n, 6, most)
        assert sorted(r["k"] for r in got.collect()) == sorted(want)
        assert sampling.questions_in(got).first().asDict() == {"questions": len({data[i][1] for i in want}), "rows": len(want)}


def test_topk_methods_agree(spark):
    rows = spark.createDataFrame([(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(40)], "item_id long, vector array<double>")
    asked = rows.filter("item_id < 5").withColumnRenamed("item_id", "query_id")

    def of(f):
        return [(r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in f(asked, rows, 5, True).orderBy("query_id", "rank").collect()]

    assert of(vector_search.topk_native) == of(vector_search.topk_block)


def test_topk_with_string_identifiers(spark):
    items = spark.createDataFrame([(f"7:{k:04d}", [1.0, float(k % 3)]) for k in range(9)], "item_id string, vector array<double>")
    queries = spark.createDataFrame([("qa_0001", [1.0, 1.0]), ("qa_0000", [0.0, 1.0]), ("none", None)], "query_id string, vector array<double>")
    both = [[(r["query_id"], r["rank"], r["item_id"]) for r in f(queries, items, 4).orderBy("query_id", "rank").collect()] for f in (vector_search.topk_native, vector_search.topk_block)]
    assert both[0] == both[1] and both[0][4:7] == [("qa_0001", 1, "7:0001"), ("qa_0001", 2, "7:0004"), ("qa_0001", 3, "7:0007")]
    assert vector_search.topk_block(queries.filter("vector is null"), items, 4).schema["query_id"].dataType.simpleString() == "string"


def test_topk_without_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "query_id long, vector array<double>")
    for method in (vector_search.topk_native, vector_search.topk_block):
        got = [(r["query_id"], r["item_id"], r["rank"]) for r in method(queries, items, 5).orderBy("rank").collect()]
        assert got == [(7, 1, 1), (7, 3, 2)] and method(queries.limit(0), items, 5).count() == method(queries, items.limit(0), 5).count() == 0


JATS = b"""<set><article><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta><article-id pub-id-type="pmid">11</article-id>
<article-id pub-id-type="pmc">PMC5</article-id><title-group><article-title>T <i>x</i></article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Jo</given-names></name></contrib></contrib-group>
<abstract><sec><title>Aim</title><p>One.</p></sec></abstract></article-meta></front>
<body><sec><title>Intro</title><p>a<fig>no</fig> b</p><sec><title>Sub</title><p>c</p></sec></sec><sec><p>untitled</p></sec></body></article></set>"""


def test_articles(spark):
    got = articles.parse_article(JATS)
    assert (got["pmid"], got["pmcid"], got["title"], got["authors"], got["abstract"]) == ("11", "5", "T x", ["Doe, Jo"], [("Aim", "One.")])
    assert got["body"] == [("Intro", "a bSubc")] and articles.split_bundle(JATS)[0][0] == "5"
    with pytest.raises(ValueError):
        articles.parse_article("<a/>")
    files = spark.createDataFrame([("a.xml", bytearray(JATS)), ("b.xml", bytearray(b"<bad")), ("c.xml", bytearray(JATS.replace(b"T <i>", b"New <i>")))], "path string, content binary")
    parsed = articles.parse_files(files)
    assert parsed.filter("error is not null").count() == 1 and articles.corpus(parsed).first()["title"] == "New x"
    cites = b"<s><PubmedArticle><PMID>11</PMID><PubDate/><JournalIssue><PubDate><Year>2023</Year><Month>Jan</Month></PubDate></JournalIssue><MeshHeading><DescriptorName>M</DescriptorName></MeshHeading></PubmedArticle></s>"
    rows = articles.read_citations(spark.createDataFrame([(bytearray(cites),)], "content binary"))
    best = articles.enriched(articles.papers(articles.corpus(parsed)), rows).first()
    assert best["mesh_terms"] == ["M"] and str(best["published_at"]) == "2023-01-01"


def test_tables(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text('{"1": {"question": "a?", "question_type": "A", "111": {"Title": "t", "abstract": {"2": "x.", "1": "y."}}, "222": {"Title": "u", "abstract": {"1": "z."}}}, "2": {"question": "b?", "111": {"Title": "other", "abstract": {"1": "w."}}, "333": {"Title": "v", "abstract": {"1": "w."}}}}')
    found, asked = tables.read_lay_questions(spark, str(path))
    assert {r["pmid"]: r["sections"][0]["text"] for r in found.collect()} == {"111": "x. y.", "222": "z.", "333": "w."}
    few, one_query = tables.first_queries(found, asked, 1)
    assert {r["pmid"] for r in few.collect()} == {"111", "222"} and one_query.count() == 1
    sheet = tmp_path / "s.csv"
    sheet.write_text('﻿qa_id,chunk_id,relevant\nq1,c1, 1\nq1,c2,x\nq2,"c\n3",0\n', encoding="utf-8")
    assert sorted(r["value"] for r in tables.read_labels_csv(spark, str(sheet), "relevant").collect()) == [0, 1]
    ranked = tmp_path / "r.json"
    ranked.write_text('{"q": {"both": ["c2", "c1"]}}')
    rows = tables.read_ranked_json(spark, str(ranked))
    assert [(r["rank"], r["item_id"]) for r in rows.orderBy("rank").collect()] == [(1, "c2"), (2, "c1")]
    tables.write_ranked_json(rows, str(tmp_path / "out"))
    assert tables.read_ranked_json(spark, str(tmp_path / "out")).count() == 2


def test_model_cache(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def call(texts):
        for t in texts:
            (log / t).write_text("")
        return [[float(len(t))] for t in texts]

    cache = str(tmp_path / "cache")
    first = models.embed(spark.createDataFrame([("a",), ("bb",)], "t string"), "t", cache, "m", call)
    assert {r["t"]: r["embedding"] for r in first.collect()} == {"a": [1.0], "bb": [2.0]}
    for p in log.iterdir():
        p.unlink()
    models.embed(spark.createDataFrame([("a",), ("ccc",)], "t string"), "t", cache, "m", call).collect()
    assert [p.name for p in log.iterdir()] == ["ccc"]


def test_two_judges(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def judge(name, rule):
        def call(system, user):
            (log / f"{name}-{user}").write_text("")
            return '{"relevant": %d}' % rule(user), 1, 1

        return call

    rows = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("q", "d")], "question string, content string")
    calls = (judge("A", lambda u: u in ("q a", "q b")), judge("B", lambda u: u in ("q a", "q c")), judge("C", lambda u: u == "q c"))
    got = models.judge_twice(rows, "{question} {chunk}", str(tmp_path / "cache"), ("A", "B", "C"), calls).collect()
    assert {r["content"]: (r["judge_a"], r["judge_b"], r["final"]) for r in got} == {"a": (True, True, True), "b": (True, False, False), "c": (False, True, True), "d": (False, False, False)}
    assert sorted(p.name for p in log.iterdir() if p.name[0] == "C") == ["C-q b", "C-q c"]
    assert models.probe(lambda texts: [[0.0] * 3 for _ in texts]) == 3
    with pytest.raises(ValueError):
        models.probe(lambda texts: [[]])


def test_readings_of_growing_answers_are_kept_apart(spark, tmp_path):
    """With more partitions than buckets answers are shuffled; a reused shuffle would have the first judge's answers only."""
    names = {"spark.sql.shuffle.partitions": "20", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        rows = spark.createDataFrame([("q", t) for t in "abcd"], "question string, content string")
        calls = tuple(lambda system, user, yes=yes: ('{"relevant": %d}' % (user[2:] in yes), 1, 1) for yes in ("ab", "ac", "c"))
        got = models.judge_twice(rows, "{question} {chunk}", str(tmp_path / "cache"), ("A", "B", "C"), calls).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {r["content"]: (r["judge_a"], r["judge_b"], r["final"]) for r in got} == {"a": (True, True, True), "b": (True, False, False), "c": (False, True, True), "d": (False, False, False)}


def test_experiment(spark):
    texts = ["red apple pie", "green apple", "blue whale song", "whale watching tour", "stone bridge"]
    chunks = spark.createDataFrame([(k, t, t + "\nWhat is it?") for k, t in enumerate(texts)], "item_id long, content string, enriched string")
    asked = spark.createDataFrame([(10, "apple", "green apple"), (11, "whale", None), (12, "nothing", "nothing")], "query_id long, question string, rewritten string")
    source = spark.createDataFrame([(10, 0, 0), (12, 0, 4)], "query_id long, pos int, item_id long")

    def embed(rows):
        return vector_search.hash_embedding(rows, "item_id", F.col("text"))

    def judge(rows):
        return agreement.with_tiebreak(rows, F.contains(F.col("content"), F.col("question")), F.contains(F.col("content"), F.col("question")), F.lit(True))

    with pytest.raises(ValueError):
        experiment.run(chunks, asked, source, embed, judge, Settings(top_k=1, pool_depth=2))
    found = experiment.run(chunks, asked, source, embed, judge, Settings(top_k=2, pool_depth=2))
    best = {(r["variant"], r["query_id"]): r["item_id"] for r in found.hits.filter("rank = 1").collect()}
    assert best["baseline", 10] == best["qr_only", 10] == best["hq_only", 10] == 1 and best["baseline", 11] in (2, 3)
    assert found.hits.count() == 4 * 3 * 2
    labels = {(r["query_id"], r["item_id"]): r["final"] for r in found.labels.collect()}
    assert labels[10, 0] and labels[10, 1] and not labels[12, 4]
    assert [r["query_id"] for r in found.excluded.collect()] == [12]
    means = {r["variant"]: r for r in found.means.collect()}
    assert set(means) == {"baseline", "qr_only", "hq_only", "both"} and means["baseline"]["mrr"] == 1.0
    assert found.comparisons.count() == found.robustness.count() == 12


def test_experiment_sinks(spark, tmp_path):
    import json

    from skerry import schemas

    rows = [("10", None, None, "T", None, None, [("A", "xyz"), (None, None)], []), ("9", None, None, None, None, None, None, [("B", "é")]), ("8", None, None, "U", None, None, [("A", ""), ("B", "1")], None)]
    parsed = spark.createDataFrame(rows, schemas.ARTICLE)
    tables.write_articles(parsed, str(tmp_path / "articles"))
    stats = {r["pmid"]: (r["n_abstract_sections"], r["n_body_sections"], r["abstract_chars"], r["body_chars"]) for r in tables.read_article_statistics(spark, str(tmp_path / "articles")).collect()}
    assert stats == {"10": (2, 0, 3, 0), "9": (0, 1, 0, 1), "8": (2, 0, 1, 0)}
    assert {r["n_sections"]: (r["articles"], r["share"]) for r in tables.section_histogram(parsed).collect()} == {0: (1, 0.33), 2: (2, 0.67)}
    tables.write_ids(parsed.union(parsed), "pmid", str(tmp_path / "ids"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["8", "9", "10"]
    chunks = spark.createDataFrame([("9:0000", "c", ["q?"])], "chunk_id string, content string, hq_questions array<string>")
    tables.write_enrichment(chunks, str(tmp_path / "hq"))
    assert json.loads(spark.read.text(str(tmp_path / "hq")).first()["value"]) == {"9:0000": {"content": "c", "hq_questions": ["q?"]}}
    tables.write_rewrites(spark.createDataFrame([("qa_0000", "a", "b")], "qa_id string, question string, rewritten string"), str(tmp_path / "rewrites"))
    assert json.loads(spark.read.text(str(tmp_path / "rewrites")).first()["value"]) == {"qa_0000": {"original": "a", "rewritten": "b"}}
    labels_ = spark.createDataFrame([(1, 0, "x", True, False, True), (1, 1, "y", False, False, False)], "query_id long, pos int, item_id string, judge_a boolean, judge_b boolean, final boolean")
    tables.write_gold(labels_, agreement.report(labels_, "judge_a", "judge_b"), str(tmp_path / "gold"))
    assert spark.read.json(str(tmp_path / "gold/gold")).first()["relevant_ids"] == ["x"] and {r["final"] for r in spark.read.json(str(tmp_path / "gold/labels")).collect()} == {0, 1}


def test_pages():
    assert pages.parse_html("<html><head><title> T </title><style>x</style></head><body><p>a <b>b</b></p><script>no</script><div>c</div></body></html>") == ("T", ["a b", "c"])


def test_streaming_ingest(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id long, text string"
    for text in ("x" * 1500, "y" * 10):
        spark.createDataFrame([(1, text)], schema).write.mode("append").parquet(source)
        ingest.ingest(spark, source, schema, out, state)
    rows = {r["chunk_id"]: r["content"] for r in ingest.collection_rows(spark, out).collect()}
    assert rows["1:0000"] == "y" * 10 and len(rows) == 2


def test_registered_queries_import():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_workspace(spark, monkeypatch):
    from types import SimpleNamespace

    from skerry import workspace

    table = workspace.materialize(spark.range(5), "t")
    other = workspace.materialize(spark.range(3), "u")
    workspace.release(table)
    assert other.count() == 3
    with pytest.raises(Exception):
        table.count()
    outside = spark.range(2)
    workspace.release(outside)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError):
        workspace.shared_root(cluster)


def test_hash_embedding_counts_tokens_of_whole_texts(spark):
    texts = {1: "Über den Fluß, über 42 Brücken!", 2: "", 3: None, 4: "a b " * 30_000, 5: "!?", 6: "x"}
    rows = spark.createDataFrame([*texts.items(), (6, "x")], "id int, body string")
    found = sorted(tuple(r) for r in vector_search.hash_embedding(rows, "id", F.col("body")).collect())
    want = []
    for key, text in [*texts.items(), (6, "x")]:
        counts = [0.0] * 64
        for token in re.findall(r"[^\W_]+", (text or "").lower()):
            counts[int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % 64] += 1
        want.append((key, counts))
    assert found == sorted(want)
    assert vector_search.hash_embedding(rows.filter("false"), "id", F.col("body")).collect() == []


def test_block_search_has_the_same_hits_over_several_blocks(spark, monkeypatch):
    vectors = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    items = spark.createDataFrame([*vectors, (60, None)], "item_id long, vector array<double>")
    asked = items.withColumnRenamed("item_id", "query_id")
    one = sorted(map(tuple, vector_search.topk_block(asked, items, 4, exclude_self=True).collect()))
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 13)
    several = sorted(map(tuple, vector_search.topk_block(asked, items, 4, exclude_self=True).collect()))
    assert len(one) == 240 and [r[:2] for r in one] == [r[:2] for r in several]
    assert vector_search.topk_block(asked.filter("false"), items, 4).collect() == []
