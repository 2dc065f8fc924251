"""Model calls and a literature service that many tasks share: what they keep, how often they call."""

import http.server
import json
import sys
import threading
import time
import urllib.parse
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from skerry.operators import answers, models
from skerry.sources import literature

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find the tests


def asked(spark, n):
    return spark.range(n).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("question"), F.lit("qa").alias("qa_id"))


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    return folder


def calls(folder):
    return sorted((folder / p.name).read_text() for p in folder.iterdir())


def note(folder, text):
    (folder / uuid.uuid4().hex).write_text(text)


def test_a_failed_job_keeps_the_answers_of_its_finished_tasks(spark, tmp_path, log):
    """One call fails at first; the next run asks for what no finished task had brought."""
    marker, cache = tmp_path / "well", str(tmp_path / "cache")

    def call(system, user):
        if user == "q7" and not marker.exists():
            time.sleep(6)  # the other tasks end meanwhile
            raise ValueError("no answer")
        note(log, user)
        return user.upper(), 1, 1

    def run():
        return models.complete(asked(spark, 60).withColumn("system", F.lit("")), "system", "question", cache, "m", call, models.Calls(batch=5))

    with pytest.raises(Exception, match="no answer"):
        run()
    kept = answers.Answers(spark, cache, models.COMPLETION).rows().count()
    assert 40 < kept < 60
    for p in log.iterdir():
        p.unlink()
    marker.write_text("")
    assert {r["question"]: r["text"] for r in run().collect()} == {f"q{k}": f"Q{k}" for k in range(60)}
    assert len(calls(log)) == 60 - kept and "q7" in calls(log)
    assert run().count() == 60 and len(calls(log)) == 60 - kept


def test_a_probe_shuffles_the_asked_rows_only(spark, tmp_path):
    kept = answers.Answers(spark, str(tmp_path / "cache"), "n int", buckets=4)
    assert kept.bring(asked(spark, 500).withColumnRenamed("question", "cache_key"), lambda part: part[["cache_key"]].assign(n=1)) == 500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (kept.found(asked(spark, 3).withColumnRenamed("question", "cache_key")), kept.missing(asked(spark, 3).withColumnRenamed("question", "cache_key"))):
            assert plan.count() in (3, 0)
            text = plan._jdf.queryExecution().executedPlan().toString()
            table = text[text.index("FileScan parquet") :]
            above = text[: text.index("FileScan parquet")].rstrip().split("\n")[-4:]
            assert "Bucketed: true" in table and not any("Exchange" in line for line in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_key_that_was_answered_twice_counts_once(spark, tmp_path):
    kept = answers.Answers(spark, str(tmp_path / "cache"), "n int", rows_per_task=2)
    one = spark.createDataFrame([("a", 1), ("b", 2)], "cache_key string, n int")
    kept.add(one)
    kept.add(one)
    assert kept.rows().count() == 4 and kept.found(one).count() == 2 and kept.missing(one).count() == 0
    again = answers.Answers(spark.newSession(), str(tmp_path / "cache"), "n int", rows_per_task=2)
    assert again.found(one).count() == 2  # known by its files, in any session


def test_how_models_are_called(spark, tmp_path, log):
    busy = tmp_path / "busy"

    def call(system, user, **options):
        note(log, json.dumps(options, sort_keys=True))
        if user == "x" and not busy.exists():
            busy.write_text("")
            raise OSError("busy")
        return f"1. {user}?", 1, 2

    how = models.Calls(threads=4, temperature=0.2, most_tokens=9, reasoning=("o9",), sleep=lambda s: None)
    chunks = spark.createDataFrame([("c1", "x", []), ("c2", None, [])], "chunk_id string, content string, hq_questions array<string>").coalesce(1)
    cache = str(tmp_path / "cache")
    got = models.enrich(chunks, "{content}", cache, "m", call, 1, how)
    assert {r["chunk_id"]: (r["hq_questions"], r["enriched"]) for r in got.collect()} == {"c1": (["x?"], "x\nx?"), "c2": (["?"], "\n?")}
    assert set(calls(log)) == {'{"max_tokens": 9, "model": "m", "temperature": 0.2}'} and len(calls(log)) == 3
    models.enrich(chunks, "{content}", cache, "m", call, 1, models.Calls(temperature=0.9, most_tokens=9)).collect()
    assert len(calls(log)) == 5  # another temperature, other answers
    models.enrich(chunks, "{content}", cache, "o9-mini", call, 1, how).collect()
    assert calls(log).count('{"max_completion_tokens": 9, "model": "o9-mini"}') == 2

    sizes = str(tmp_path / "sizes")

    def vectors(texts):
        note(log, f"batch {len(texts)}")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("a" * k,) for k in range(7)] + [(None,)], "t string").coalesce(1)
    got = models.embed(rows, "t", sizes, "m", vectors, models.Calls(threads=2, batch=3))
    assert sorted(r["embedding"][0] for r in got.collect()) == [0, 0, 1, 2, 3, 4, 5, 6]
    assert all(int(c.split()[1]) <= 3 for c in calls(log) if c.startswith("batch"))


class Service(http.server.BaseHTTPRequestHandler):
    """25 records, some of which a fetch lacks; the times of all calls."""

    total, times, paths = 25, [], []

    def do_GET(self):
        type(self).times.append(time.monotonic())
        url = urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        type(self).paths.append((url.path, q))
        if url.path.endswith("esearch.fcgi"):
            ids = [f"{k:03d}" for k in range(int(q["retstart"]), min(self.total, int(q["retstart"]) + int(q["retmax"])))]
            body = json.dumps({"esearchresult": {"count": str(self.total), "idlist": ids}})
        else:
            body = q["id"]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    Service.total, Service.times, Service.paths = 25, [], []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def most_in_a_second(times):
    return max(sum(t <= u < t + 0.97 for u in times) for t in times)


def fetching(endpoint, key, lanes):
    """A fetch whose tasks each have a client of their lane."""
    clients = {}

    def fetch(ids):
        client = clients.setdefault("c", literature.Client(endpoint, key, lanes=lanes))
        return {i: i.encode() for i in client.fetch(ids).decode().split(",") if int(i) % 5}

    return fetch


def test_all_tasks_together_keep_the_limit(spark, tmp_path, endpoint):
    ids = spark.range(300).select(F.format_string("%03d", "id").alias("pmcid")).repartition(8)
    got = literature.fetched(ids, str(tmp_path / "cache"), fetching(endpoint, "k", 4), batch=10, lanes=4)
    assert got.count() == 240 and not got.filter("cached").count()
    assert most_in_a_second(Service.times) <= literature.RATE_WITH_KEY
    assert [len(q["id"].split(",")) for _, q in Service.paths] == [10] * 30  # full batches, however rows were dealt
    Service.paths.clear()
    again = literature.fetched(ids, str(tmp_path / "cache"), fetching(endpoint, "k", 4), batch=10, lanes=4)
    assert again.filter("cached").count() == 240 and sum(len(q["id"].split(",")) for _, q in Service.paths) == 60
    with pytest.raises(ValueError, match="lanes"):
        literature.Client(endpoint, lanes=4)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, endpoint):
    spark.dataSource.register(literature.Search)

    def take():
        rows = spark.readStream.format("literature_search").options(endpoint=endpoint, query="n", key="k", page=10).load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "found"))
        assert query.awaitTermination(120)
        pages = sorted(int(q["retstart"]) for _, q in Service.paths if q["retmax"] != "0")
        Service.paths.clear()
        return pages, sorted(r["pmcid"] for r in spark.read.parquet(str(tmp_path / "found")).collect())

    pages, found = take()
    assert set(pages) == {0, 10, 20} and found == [f"{k:03d}" for k in range(25)]
    Service.total = 32
    pages, found = take()
    assert set(pages) == {25} and found == [f"{k:03d}" for k in range(32)]


def article(number):
    return f"""<article><front><article-meta><article-id pub-id-type="pmid">{number}</article-id><article-id pub-id-type="pmc">PMC{number}</article-id>
        <title-group><article-title>T{number}</article-title></title-group></article-meta></front></article>""".encode()


def test_papers_come_with_new_citations_cached_ones_first(spark, tmp_path, log):
    def fetch(ids):
        return {i: article(i) for i in ids if i != "4"}

    def citations(ids):
        note(log, ",".join(ids))
        return ("<s>" + "".join(f"<PubmedArticle><PMID>{i}</PMID><MeshHeading><DescriptorName>M{i}</DescriptorName></MeshHeading></PubmedArticle>" for i in ids if i != "2") + "</s>").encode()

    cache = str(tmp_path / "cache")
    some = spark.createDataFrame([("3",), ("5",)], "pmcid string")
    literature.collected(some, cache, fetch, citations, batch=2, lanes=2)
    for p in log.iterdir():
        p.unlink()
    rows = literature.collected(spark.createDataFrame([(str(k),) for k in range(1, 6)], "pmcid string"), cache, fetch, citations, batch=2, lanes=2)
    got = [(r["pmcid"], r["title"], r["mesh_terms"], r["cached"]) for r in rows.orderBy("place").collect()]
    assert got == [("3", "T3", ["M3"], True), ("5", "T5", ["M5"], True), ("1", "T1", ["M1"], False), ("2", "T2", [], False)]
    assert calls(log) == ["1,2", "3,5"]
