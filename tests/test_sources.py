import http.server
import json
import os
import random
import re
import threading
import urllib.parse
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry import workspace
from skerry.config import Settings
from skerry.functions import text as tx
from skerry.operators import corpus, metrics, models, pooling, statistics, vector_search
from skerry.plans import interchange
from skerry.sources import articles, literature, tables


def test_published_statistics(spark):
    """Statistics, both p-values, verdicts and flips of a published run, from its scores of each query."""
    with open(os.path.join(os.path.dirname(__file__), "golden", "paired_tests.json")) as f:
        golden = json.load(f)
    rows = [(v, q, r, n) for v, s in golden["scores"].items() for q, (r, n) in enumerate(zip(s["recall_at_10"], s["ndcg_at_10"]))]
    scores = spark.createDataFrame(rows, "variant string, query_id int, recall_at_10 double, ndcg_at_10 double").repartition(4)
    names = ["baseline", "qr_only", "hq_only", "both"]
    pairs = statistics.variant_pairs(scores, names)
    found = {(r["a"], r["b"], r["metric"]): r for r in statistics.ablation(scores, names).collect()}
    verdicts = statistics.robustness(pairs, 12)
    both = {(r["a"], r["b"], r["metric"]): r for r in verdicts.collect()}
    assert len(found) == len(both) == 12
    for a, b, metric, mean_a, mean_b, statistic, p, p_t, by_w, by_t in golden["expected"]:
        r, v = found[a, b, metric], both[a, b, metric]
        assert (r["mean_a"], r["mean_b"], r["statistic"]) == (pytest.approx(mean_a, rel=1e-12), pytest.approx(mean_b, rel=1e-12), statistic)
        assert r["p_value"] == pytest.approx(p, rel=1e-10) and v["p_ttest"] == pytest.approx(p_t, rel=1e-9)
        assert (r["significant"], v["by_wilcoxon"], v["by_ttest"], v["flipped"]) == (by_w, by_w, by_t, by_w != by_t)
    assert statistics.flips(verdicts).first().asDict() == {"comparisons": 12, "flipped": 1}


def test_signed_ranks_against_brute_force(spark):
    rng = random.Random(3)
    data = [("a", "b", f"m{m}", q, rng.randint(0, 6) / 4, rng.randint(0, 6) / 4) for m in range(3) for q in range(rng.randint(1, 60))]
    got = {r["metric"]: r for r in statistics.wilcoxon_parts(spark.createDataFrame(data, "a string, b string, metric string, query_id int, x double, y double").repartition(5)).collect()}
    for m in ("m0", "m1", "m2"):
        d = [x - y for _, _, k, _, x, y in data if k == m]
        used = sorted(abs(v) for v in d if v)
        rank = {v: used.index(v) + (used.count(v) + 1) / 2 for v in used}
        plus, minus = sum(rank[v] for v in d if v > 0), sum(rank[-v] for v in d if v < 0)
        assert (got[m]["pairs"], got[m]["n"], got[m]["statistic"]) == (len(d), len(used), min(plus, minus) if len(d) > 1 and used else 0.0)


def test_pairs_need_all_variants(spark):
    rows = [("baseline", 1, 0.5, 0.1), ("both", 1, 0.7, 0.2), ("baseline", 2, 0.1, 0.1), ("other", 1, 9.0, 9.0)]
    scores = spark.createDataFrame(rows, "variant string, query_id int, recall_at_10 double, ndcg_at_10 double")
    got = sorted(tuple(r) for r in statistics.variant_pairs(scores, ["baseline", "both"]).collect())
    assert got == [("baseline", "both", "ndcg_at_10", 1, 0.1, 0.2), ("baseline", "both", "recall_at_10", 1, 0.5, 0.7)]
    assert {(r["variant"], r["query_id"]) for r in metrics.common(scores, ["baseline", "both"]).collect()} == {("baseline", 1), ("both", 1)}


def test_changes(spark):
    deltas = spark.createDataFrame([("v", q, d, "worse" if d < 0 else "better" if d > 0 else "same") for q, d in enumerate([0.5, -0.25, 0.0, -0.5, 0.75, -0.5])], "variant string, query_id int, delta double, change string")
    assert [r["query_id"] for r in metrics.ordered_changes(deltas, "worse").collect()] == [3, 5, 1]
    assert [r["query_id"] for r in metrics.ordered_changes(deltas, "better", 1).collect()] == [4]
    rewrites = spark.createDataFrame([(q, "ab", "ab" * (1 + q % 2)) for q in range(6)] + [(9, "", "x")], "query_id int, original string, rewritten string")
    got = {r["expanded"]: (r["n"], r["mean_delta"]) for r in metrics.by_expansion(metrics.with_rewrites(deltas, rewrites)).collect()}
    assert got == {True: (3, pytest.approx(-1.25 / 3)), False: (3, pytest.approx(1.25 / 3))}


def test_labels_instead_of_gold_lists(spark):
    rng = random.Random(8)
    labels = [(k, rng.randint(0, 4)) for k in range(40)] + [(99, 77)]
    hits = [("v", q, r + 1, i) for q in (0, 10, 20, 99) for r, i in enumerate(rng.sample([k for k, _ in labels if k != q], 10))]
    table, found = spark.createDataFrame(labels, "item_id long, label int"), spark.createDataFrame(hits, "variant string, query_id long, rank int, item_id long")
    asked = table.filter(F.col("item_id").isin(0, 10, 20, 99)).withColumnRenamed("item_id", "query_id")
    gold = spark.createDataFrame([(q, i) for q, a in labels for i, b in labels if a == b and q != i], "query_id long, item_id long")
    columns = ("variant", "query_id", "n_gold", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")
    want = {r["query_id"]: r for r in metrics.per_query(found, gold, keep_empty=False).select(*columns).collect()}
    got = {r["query_id"]: r for r in metrics.of_labels(found, table, asked).select(*columns).collect()}
    assert got == want and 99 not in got and len(got) == 3


def test_top_k_in_blocks(spark, monkeypatch):
    """Several blocks of queries, small whole numbers as identifiers, which keep their types."""
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
    rows = spark.createDataFrame([(i, [float((i * 5 + j * 3) % 7 - 3) for j in range(4)]) for i in range(30)], "item_id int, vector array<float>")
    asked = rows.filter("item_id < 10").withColumnRenamed("item_id", "query_id")
    got = vector_search.topk_block(asked, rows, 4, True)
    assert [got.schema[c].dataType.simpleString() for c in ("query_id", "item_id")] == ["int", "int"]
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 100)
    key = lambda r: (r["query_id"], r["rank"], r["item_id"], round(r["score"], 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, vector_search.topk_native(asked, rows, 4, True).collect()))


def test_citations_last_wins(spark):
    def file(*terms):
        return bytearray(("<s>" + "".join(f"<PubmedArticle><PMID>1</PMID><MeshHeading><DescriptorName>{t}</DescriptorName></MeshHeading></PubmedArticle>" for t in terms) + "</s>").encode())

    cites = articles.read_citations(spark.createDataFrame([("b.xml", file("x", "last")), ("a.xml", file("y", "z"))], "path string, content binary"))
    parsed = spark.createDataFrame([("1", "t"), ("2", "u"), ("3", "")], "pmid string, title string")
    for c in ("doi", "journal"):
        parsed = parsed.withColumn(c, F.lit(None).cast("string"))
    got = {r["pmid"]: r for r in articles.enriched(articles.papers(parsed.withColumn("authors", F.array().cast("array<string>"))), cites).collect()}
    assert {k: r["mesh_terms"] for k, r in got.items()} == {"1": ["last"], "2": []}
    assert set(next(iter(got.values())).asDict()) == {"pmid", "doi", "title", "journal", "authors", "mesh_terms", "published_at", "full_text"}
    assert articles.unknown_citations(parsed.filter("pmid = '2'"), cites).count() == 1


def test_folders(spark, tmp_path):
    with pytest.raises(ValueError):
        (tmp_path / "note.txt").write_text("x")
        articles.read_articles(spark, str(tmp_path))
    (tmp_path / "a.xml").write_text("<article><front><article-meta><article-id pub-id-type='pmid'>1</article-id></article-meta></front></article>")
    assert articles.read_articles(spark, str(tmp_path)).first()["pmid"] == "1"
    assert tables.query_string("asthma") == "asthma[MeSH] AND open access[filter] AND english[lang]"
    (tmp_path / "p.md").write_text("\n ask {x} \n")
    assert tables.prompt(str(tmp_path / "p.md")) == "ask {x}"
    assert Settings.from_env({"SKERRY_CHUNK_SIZE": "7", "SKERRY_ALPHA": "0.1"}) == Settings(chunk_size=7, alpha=0.1)
    assert tables.read_run(spark, str(tmp_path / "none")) == {}
    tables.write_run(spark, str(tmp_path / "run"), top_k=10, model="m")
    assert tables.read_run(spark, str(tmp_path / "run")) == {"top_k": 10, "model": "m"}


def test_sheets_and_collections(spark, tmp_path):
    sheet = spark.createDataFrame([(2, 'a "b"\nc'), (1, "é")], "nr int, text string")
    tables.write_sheet(sheet, str(tmp_path / "s"), mark=True)
    (part,) = [p for p in os.listdir(tmp_path / "s") if p.endswith(".csv")]
    raw = (tmp_path / "s" / part).read_bytes().decode()
    assert raw.startswith("﻿nr,text") or raw.startswith('"﻿nr",text')
    assert raw.split("\n")[1] == "1,é"
    store = tables.Collection(spark, str(tmp_path / "c"), 2)
    assert store.rows() is None
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "chunk_id string, embedding array<double>")
    store.upsert(rows)
    store.upsert(spark.createDataFrame([("b", [0.0, 0.0]), ("c", [5.0, 6.0])], "chunk_id string, embedding array<double>"))
    assert {r["chunk_id"]: r["embedding"] for r in store.rows().collect()} == {"a": [1.0, 2.0], "b": [0.0, 0.0], "c": [5.0, 6.0]}
    with pytest.raises(Exception, match="2 dimensions"):
        store.upsert(rows.withColumn("embedding", F.array(F.lit(1.0))))
    assert store.rows().count() == 3
    store.reset()
    assert store.rows() is None


def test_several_ranked_objects(spark, tmp_path):
    (tmp_path / "r.json").write_text('{\n "q": {\n  "both": [\n   "c2"\n  ]\n }\n}\n{"r": {"both": ["c1", "c3"]}}')
    assert {(r["query_id"], r["rank"], r["item_id"]) for r in tables.read_ranked_json(spark, str(tmp_path / "r.json")).collect()} == {("q", 1, "c2"), ("r", 1, "c1"), ("r", 2, "c3")}


def test_client_waits_and_repeats():
    now, slept, urls, fail = [0.0], [], [], [3]

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    def opener(url):
        urls.append(url)
        if fail[0]:
            fail[0] -= 1
            raise OSError("busy")
        return json.dumps({"esearchresult": {"idlist": ["7", "8"]}}).encode()

    client = literature.Client("http://x/", clock=lambda: now[0], sleep=sleep, opener=opener)
    assert client.search("a b", 2) == ["7", "8"] and len(urls) == 4 and "term=a+b" in urls[0] and "api_key" not in urls[0]
    assert [int(s) for s in slept] == [2, 4, 8]
    client.search("a", 1)
    assert slept[-1] == pytest.approx(1 / 3)
    keyed = literature.Client("http://x", key="k", clock=lambda: now[0], sleep=sleep, opener=opener)
    keyed.fetch(["1", "2"])
    keyed.fetch(["3"])
    assert slept[-1] == pytest.approx(0.1) and "api_key=k" in urls[-1]
    fail[0] = 9
    with pytest.raises(OSError):
        client.search("a", 1)
    assert fail[0] == 4


def test_search_as_a_data_source(spark, monkeypatch):
    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            body = json.dumps({"esearchresult": {"idlist": [f"{q['term']}{k}" for k in range(int(q["retstart"]), min(25, int(q["retstart"]) + int(q["retmax"])))]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(literature.Search)
        rows = spark.read.format("literature_search").options(endpoint=f"http://127.0.0.1:{server.server_port}", query="n", most=20, key="k").load()
        assert [(r["position"], r["pmcid"]) for r in rows.orderBy("position").collect()] == [(k, f"n{k}") for k in range(20)]
        lanes = literature._SearchReader({"most": "35000"}).partitions()
        assert [p.pages for p in lanes] == [[(0, 10_000), (30_000, 5_000)], [(10_000, 10_000)], [(20_000, 10_000)]]
    finally:
        server.shutdown()


def test_calls(spark, tmp_path):
    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return x * 2

    assert models.retried(flaky, sleep=lambda s: None)(4) == 8 and len(tries) == 3
    with pytest.raises(ValueError):
        models.retried(lambda: int("x"), sleep=lambda s: None)()
    assert models.threaded(lambda x: x * x, 4)(list(range(50))) == [x * x for x in range(50)]
    assert models.chat_options("o9-x", 0.2, 10, ("o9",)) == {"model": "o9-x", "max_completion_tokens": 10}
    assert models.chat_options("m", 0.2, 10, ("o9",)) == {"model": "m", "temperature": 0.2, "max_tokens": 10}
    chunks = spark.createDataFrame([(f"c{k}", f"text {k}", []) for k in range(4)], "chunk_id string, content string, hq_questions array<string>")
    got = models.inspected(chunks, 2, "Ask {n} of {content}", str(tmp_path / "cache"), "m", lambda s, u: ("1. A?\n2. B?", 3, 4), k=1).first()
    assert (got["chunk_id"], got["prompt"], got["answer"], got["total_tokens"], got["questions"], got["enriched"]) == ("c2", "Ask 1 of text 2", "1. A?\n2. B?", 7, ["A?"], "text 2\nA?")


def test_descriptions_of_nothing(spark):
    none = spark.createDataFrame([], "k long, t string, n long")
    assert corpus.title_counts(none, F.col("t")).count() == 0 and corpus.candidate_share(none, F.col("t"), ["a"]).first()["share"] is None
    assert corpus.summary(none, ["k"], "t").first()["n"] == 0 and corpus.described(none, "n").first()["mean"] is None and corpus.extremes(none, "k", "n").first()["longest"] is None
    rows = spark.createDataFrame([(1, " 2.1 Methods "), (2, "METHODS "), (3, "Methodology"), (4, None)], "k long, t string")
    assert {r["title"]: r["n"] for r in corpus.title_counts(rows, F.col("t")).collect()} == {"methods": 2, "methodology": 1, None: 1}
    assert {r["candidate"]: r["n"] for r in corpus.candidate_share(rows, F.col("t"), ["method", "methods"]).collect()} == {"method": 3, "methods": 2}
    assert Counter(r["key"] for r in corpus.one_per_key(rows, F.col("k") % 2, "k", True).collect()) == {0: 1, 1: 1}
    assert pooling.pool(none.select(F.col("k").alias("query_id"), F.col("t").alias("item_id"), F.lit(0).alias("pos")), none.select(F.col("k").alias("query_id"), F.lit(1).alias("rank"), F.col("t").alias("item_id"))).count() == 0
    assert tx.strip(F.lit("x")) is not None


def test_json_entries_in_pieces():
    rng = random.Random(6)
    for _ in range(60):
        values = {f"k{n}": {"q": rng.choice(['a}b"c', "\\", "{[", "é\n}", ""]), "x": rng.choice([[], [{"y": 1}], {"z": "}"}])} for n in range(rng.randint(0, 5))}
        raw = json.dumps(values, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"])
        entries = tables.JsonEntries()
        pieces = raw.split("}")
        got = [e for k, p in enumerate(pieces) for e in entries.feed(p + ("}" if k + 1 < len(pieces) else ""))]
        entries.end()
        assert got == list(values.items())
    entries = tables.JsonEntries()
    list(entries.feed('{"a": {"b": 1}'))
    with pytest.raises(ValueError, match="whole"):
        entries.end()


@pytest.mark.parametrize("split", ["128m", "64"])
def test_lay_questions_of_files_in_splits(spark, tmp_path, split):
    """Small splits: the order of entries is that of the file, not of the tasks."""
    files = {f"f{f}": {f"q{f}{n}": {"question": f"{{{n}}} \"}}\" {'x' * n}", "question_type": "A", str(n % 7): {"Title": f"t{f}{n}", "abstract": {"2": "b }", "1": "a"}}, f"{f}9{n}": {"Title": "", "abstract": {}}} for n in range(30)} for f in range(3)}
    for name, values in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(values, indent=1 if name == "f1" else None))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        articles_, queries = tables.read_lay_questions(spark, str(tmp_path))
        asked = [(r["qid"], r["question"], r["gold_pmids"]) for r in queries.orderBy("at").collect()]
        assert asked == [(q, e["question"], [k for k in e if not k.startswith("question")]) for v in files.values() for q, e in v.items()]
        found = {r["pmid"]: (r["title"], r["sections"][0]["text"]) for r in articles_.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for v in files.values():
        for e in v.values():
            for k, a in e.items():
                if not k.startswith("question"):
                    want.setdefault(k, (a["Title"], " ".join(a["abstract"].values())))
    assert found == want


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_bundles_in_splits(spark, tmp_path, split):
    def article(n, extra=""):
        return f'<article a="{n}"><front><article-meta><article-id pub-id-type="pmc">PMC{n}</article-id></article-meta></front><body>{extra}<p m:k="1">é{n} http://x y:z</p><sub-article/></body></article>'

    body = "\n".join(article(n, "</p>" if n in (40, 41) else "") for n in range(300))
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?><set xmlns:m="urn:m">{body}<article><front/></article></set>\n')
    (tmp_path / "b.xml").write_text(f"<set>{article(900)}<article><unfinished")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = articles.read_bundles(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows.sort(key=lambda r: (r["path"], r["place"]))
    a = [r for r in rows if r["path"].endswith("a.xml")]
    assert [r["pmcid"] for r in a] == [None if n in (40, 41) else str(n) for n in range(300)] and all((r["error"] is None) == (r["pmcid"] is not None) for r in a)
    assert f"é{7}" in bytes(a[7]["content"]).decode() or "&#233;7" in bytes(a[7]["content"]).decode()
    b = [(r["pmcid"], r["error"] is None) for r in rows if r["path"].endswith("b.xml")]
    assert b == [("900", True), (None, False)]


def test_records_go_on_before_all_files_of_a_batch_are_read(monkeypatch):
    """The rows of few files are in memory at once, and a task that stops early has read no further."""
    monkeypatch.setattr(articles, "PIECE_BYTES", 8)
    read = []

    def of(path, raw):
        read.append(path)
        return [{"path": path, "n": k} for k in range(3)]

    batch = pa.RecordBatch.from_pydict({"path": list("abcde"), "content": [b"12345"] * 5})
    parts = articles.in_pieces(of, pa.schema([("path", pa.string()), ("n", pa.int32())]))(iter([batch]))
    assert next(parts).num_rows == 6 and read == ["a", "b"]
    assert [part.num_rows for part in parts] == [6, 3] and read == list("abcde")


def test_articles_of_a_bundle_go_on_before_all_of_a_batch_are_parsed(monkeypatch):
    """Few articles are in memory at once, and more than one leaves at a time."""
    monkeypatch.setattr(articles, "PIECE_BYTES", 50)
    read, single = [], articles._single
    monkeypatch.setattr(articles, "_single", lambda piece: read.append(piece) or single(piece))
    one = '<article><article-id pub-id-type="pmc">{}</article-id>{}'
    pieces = [one.format(k, "<p>" if k == 3 else "") for k in range(5)] + ["<article>"]
    batch = pa.RecordBatch.from_pydict({"path": ["a"] * 6, "place": [{"block": 0, "row": k} for k in range(6)], "piece": pieces})
    parts = articles._single_in_pieces(iter([batch]))
    assert next(parts).num_rows == 1 and len(read) == 1
    monkeypatch.setattr(articles, "PIECE_BYTES", 100)
    parts = list(articles._single_in_pieces(iter([batch])))
    assert [p.num_rows for p in parts] == [2, 2, 1]
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(r["place"]["row"], r["pmcid"], r["error"] is None) for r in rows] == [(0, "0", True), (1, "1", True), (2, "2", True), (3, None, False), (4, "4", True)]


def test_prefixes_of_names():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices("<</  :::ab1_.-é\n=", k=30))
        assert articles._prefixes(text) == set(re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", text))


def test_bundles_are_parsed_once(spark, monkeypatch):
    """What is parsed is written; the three plans that read it don't parse anew."""
    written, write = [], workspace.materialize
    monkeypatch.setattr(workspace, "materialize", lambda rows, label: written.append(label) or write(rows, label))
    rows = interchange.bundles_read(spark, "/root/testdata/sf0.001")
    assert written == ["articles", "bodies"] and "MapInArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert rows.count() == docs and rows.filter("not parsed").count() == rows.filter("body_md5 is null").count() > 0
